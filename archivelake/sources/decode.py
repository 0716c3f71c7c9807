"""Bulk MIME decode job: raw bytes to headers, part tree and text."""

from __future__ import annotations

from collections.abc import Iterator
from email.header import decode_header, make_header
from email.message import Message
from email.parser import BytesParser
from email.policy import compat32

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archivelake.schema import DECODED
from archivelake.session import short_batches

#: A message takes many times its size while it is decoded, so few are decoded at once:
#: this many rows, or a row less than go over this many bytes.
SLICE_ROWS, SLICE_BYTES = 100, 1 << 20


def _decode_words(value: str) -> str:
    try:
        text = str(make_header(decode_header(value)))
    except (LookupError, UnicodeError, ValueError):
        text = value
    return text.encode("utf-8", "replace").decode("utf-8")


def _headers(message: Message) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for name, value in message.items():
        out.setdefault(name.lower(), []).append(_decode_words(str(value)))
    return out


def _text(part: Message, body: bytes, submessage: bool) -> str | None:
    """Decoded text of a leaf part; None for HTML and binary parts."""
    kind = part.get_content_type()
    if kind in ("text/html", "text/xhtml"):
        return None
    if kind == "application/octet-stream":
        text = body.decode("utf-8", "replace")
        printable = all(c.isprintable() or c.isspace() for c in text)
        return text if printable and "�" not in text else None
    if not kind.startswith("text/") and not kind.startswith("multipart/"):
        return None
    charset = part.get_content_charset() or "utf-8"
    for name in (charset, "utf-8"):
        try:
            return body.decode(name)
        except (LookupError, UnicodeError):
            continue
    return body.decode("latin-1")


def _leaf_body(part: Message) -> bytes:
    payload = part.get_payload(decode=True)
    if payload is None:
        inner = part.get_payload()
        payload = inner if isinstance(inner, str) else ""
        payload = payload.encode("utf-8", "replace")
    return payload


def _parts(root: Message) -> list[dict]:
    """Pre-order walk with depth and dotted index."""
    out: list[dict] = []
    stack = [(root, 0, "1", False)]
    while stack:
        part, depth, idx, submessage = stack.pop()
        children = part.get_payload() if part.is_multipart() else []
        embedded = part.get_content_maintype() == "message"
        container = bool(children)
        body = b"" if container else _leaf_body(part)
        filename = part.get_filename()
        out.append(
            {
                "idx": idx,
                "depth": depth,
                "content_type": str(part.get("Content-Type") or "text/plain"),
                "filename": None if filename is None else _decode_words(filename),
                "description": part.get("Content-Description"),
                "encoding": part.get("Content-Transfer-Encoding"),
                "is_submsg": submessage,
                "is_container": container,
                "text": None if container else _text(part, body, submessage),
                "body": body,
            }
        )
        prefix = "" if depth == 0 else idx + "."
        for i in range(len(children), 0, -1):
            stack.append((children[i - 1], depth + 1, f"{prefix}{i}", embedded))
    return out


def decode_one(raw: bytes) -> dict:
    """Headers, parts, undecoded body and an error text of one message."""
    cut = raw.find(b"\n\n")
    crlf = raw.find(b"\r\n\r\n")
    if crlf >= 0 and (cut < 0 or crlf < cut):
        body = raw[crlf + 4 :]
    else:
        body = raw[cut + 2 :] if cut >= 0 else b""
    try:
        message = BytesParser(policy=compat32).parsebytes(raw)
        return {
            "headers": _headers(message),
            "parts": _parts(message),
            "body": body,
            "decode_error": None,
        }
    except Exception as exc:  # a broken message must not lose its row
        return {
            "headers": {}, "parts": [], "body": body,
            "decode_error": f"{type(exc).__name__}: {exc}",
        }


def slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows within SLICE_ROWS and SLICE_BYTES, at least a row each."""
    low = total = 0
    for at, size in enumerate(sizes):
        if at > low and (at - low == SLICE_ROWS or total + size > SLICE_BYTES):
            yield low, at
            low, total = at, 0
        total += size
    if low < len(sizes):
        yield low, len(sizes)


def decode(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """Add `headers`, `parts`, `body` and `decode_error` to every row.

    A worker holds a short Arrow batch and the decoded messages of a slice of it.
    """
    short_batches(messages.sparkSession)
    schema = T.StructType(
        messages.schema.fields
        + T.StructType.fromDDL(DECODED).fields
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low, high in slices([len(r or b"") for r in batch[raw]]):
                part = batch.iloc[low:high]
                decoded = pd.DataFrame(
                    [decode_one(bytes(r or b"")) for r in part[raw]],
                    columns=["headers", "parts", "body", "decode_error"],
                    index=part.index,
                )
                yield pd.concat([part, decoded], axis=1)

    return messages.mapInPandas(run, schema)


def explode_parts(decoded: DataFrame) -> DataFrame:
    """One row per MIME part, with its position in the walk.

    The part's own `body` takes the place of the whole message's.
    """
    rest = [c for c in decoded.columns if c not in ("parts", "body")]
    return decoded.select(*rest, F.posexplode("parts").alias("part_pos", "part")).select(
        *rest, "part_pos", "part.*"
    )
