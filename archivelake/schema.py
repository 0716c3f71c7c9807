"""Table schemas."""

from __future__ import annotations

RAW_MESSAGES = (
    "inbox string, seq bigint, op string, at bigint, ct bigint, oid string, "
    "raw binary, path string"
)
PART = (
    "idx:string, depth:int, content_type:string, filename:string, "
    "description:string, encoding:string, is_submsg:boolean, "
    "is_container:boolean, text:string, body:binary"
)
DECODED = (
    "headers map<string,array<string>>, parts array<struct<" + PART + ">>, "
    "body binary, decode_error string"
)
XREF3 = "docid bigint, inbox string, xnum bigint, oid string"
ANNOTATIONS = "docid bigint, kw array<string>, labels array<string>"
BLOB_LOCATIONS = "oid string, folder string, uid bigint, name string"
POSTINGS = "docid bigint, field string, term string, wdf bigint, positions array<bigint>"
