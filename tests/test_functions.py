"""Column functions on small inputs of our own."""

import pytest
from pyspark.sql import functions as F

from archivelake.functions import addresses, dates, diffs, hashing, ids, subjects, text


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lits(*values):
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def test_message_ids_keep_order_and_length(spark):
    long_id = "x" * 300
    got = one(spark, ids.message_ids(lits("<a@b> then <c\td@e> <a@b>", "bare", f"<{long_id}>")))
    assert got == ["a@b", "cd@e", "bare", long_id]


def test_references_drop_addresses_and_slips(spark):
    got = one(spark, ids.references(lits("<1@x> <2@x> <1@x>"), lits("<3@x> <y> <me@x>"), lits("me@x")))
    assert got == ["1@x", "2@x", "3@x"]
    cleaned = ids.clean_references(lits("1@x", "own", "2@x"), lits("own", "other"), F.lit("own"))
    assert one(spark, cleaned) == ["1@x", "2@x", "other"]
    assert one(spark, ids.in_reply_to(lits("1@x", "2@x"))) == "2@x"
    assert one(spark, ids.in_reply_to(lits())) is None


def test_compressed_ids(spark):
    assert one(spark, ids.compress_id(F.lit("short-id_1"))) == "short-id_1"
    assert len(one(spark, ids.compress_id(F.lit("has space")))) == 40
    assert len(one(spark, ids.compress_id(F.lit("a" * 41)))) == 40


def test_blob_id_is_that_of_git(spark):
    # The well-known id of an empty blob.
    assert one(spark, ids.blob_id(F.encode(F.lit(""), "UTF-8"))) == "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"


@pytest.mark.parametrize(
    "subject, want",
    [("  Re:  hello   world.. ", "hello world"), ("RE: re: x", "re: x"), ("x.", "x"), ("...", "")],
)
def test_subject_normalisation(spark, subject, want):
    assert one(spark, subjects.normalized(F.lit(subject))) == want


def test_subject_keys(spark):
    assert one(spark, subjects.subject_key(F.lit("Re: Big News!"))) == "big_news_"
    assert one(spark, subjects.subject_key(F.lit(""))) is None
    assert one(spark, subjects.subject_key(F.lit("..."))) is None
    assert one(spark, subjects.file_name(F.lit("[PATCH] a/b: fix.."))) == "PATCH-a-b-fix"
    assert one(spark, subjects.without_tag(F.lit("Re: [list] hi"), "[list]")) == "Re: hi"


@pytest.mark.parametrize(
    "before, now, want",
    [
        ("a b c", "x b c", 'x "'), ("a b c", "x y c", "x y c"), ("a b", "a b", ' "'),
        ("p q", "x y", "x y"), ("hello there all", "Re: there all", ' "'),
    ],
)
def test_subject_elision(spark, before, now, want):
    assert one(spark, subjects.elide_against(F.lit(before), F.lit(now))) == want


def test_every_half_hour_offset(spark):
    steps = list(range(-1410, 1411, 30))
    rows = [
        (m, "Fri, 02 Oct 1993 00:00:00 %s%02d%02d" % ("-" if m < 0 else "+", abs(m) // 60, abs(m) % 60))
        for m in steps
    ]
    df = spark.createDataFrame(rows, "m int, s string").select("m", dates.parse_date(F.col("s")).alias("p"))
    for r in df.collect():
        assert r.p.epoch == 749520000 - r.m * 60
        far = abs(r.m) >= 14 * 60
        want = "+0000" if far else "%s%02d%02d" % ("-" if r.m < 0 else "+", abs(r.m) // 60, abs(r.m) % 60)
        assert r.p.zone == want


@pytest.mark.parametrize(
    "value, epoch, zone",
    [
        ("Thu, 1 Jan 70 00:00:10 GMT", 10, "+0000"), ("1 Feb 103 10:00 EST", 1044111600, "-0500"),
        ("Mon, 2 Mar 09 1:02:03 XYZ", 1235955723, "+0000"),
        ("2 Mar 2009 01:02 (a comment) -500 (EST)", 1235955720 + 5 * 3600, "-0500"),
        ("2021-03-04T05:06:07Z", 1614834367, "+0000"), ("2 Smarch 2009 01:00:00 +0000", None, None),
        ("31 Dec 1960 00:00:00 +0000", None, None), ("nothing", None, None),
    ],
)
def test_odd_dates(spark, value, epoch, zone):
    got = one(spark, dates.parse_date(F.lit(value)))
    if epoch is None:
        assert got is None
    else:
        assert (got.epoch, got.zone) == (epoch, zone)


def test_received_comes_first_for_arrival(spark):
    d, r = lits("bad", "1 Jan 2020 00:00:00 +0000"), lits("from x; junk", "from y; 1 Jan 2020 00:05:00 +0100")
    sent, got = dates.sent_and_received(d, r, F.lit(1), F.lit(2))
    assert one(spark, sent).epoch == 1577836800
    assert one(spark, got).epoch == 1577836800 + 300 - 3600
    sent, got = dates.sent_and_received(lits(), lits(), F.lit(1), F.lit(2))
    assert (one(spark, sent).epoch, one(spark, got).epoch) == (1, 2)


def test_addresses(spark):
    header = F.lit('"Last, First" <fl@x.org>, plain@y.org (Comment), Some One <so@z.org>')
    assert one(spark, addresses.emails(header)) == ["fl@x.org", "plain@y.org", "so@z.org"]
    assert one(spark, addresses.names(header)) == ["Last, First", "Comment", "Some One"]
    pairs = one(spark, addresses.pairs(F.lit("bare@x.org")))
    assert [(p.name, p.addr) for p in pairs] == [(None, "bare@x.org")]


def test_masking(spark):
    value = F.lit("mail me@a.b.org or keep@ok.org, see http://u@h.org/x and x@sub.fine.net")
    got = one(spark, addresses.mask(value, ["keep@ok.org"], ["fine.net"]))
    assert got == "mail me@a•b.org or keep@ok.org, see http://u@h.org/x and x@sub.fine.net"


def test_content_hash_ignores_quotes_and_trailing_space(spark):
    def digest(sender, body, extra=""):
        headers = F.from_json(F.lit('{"message-id":["<m@x>"],"from":["%s"],"subject":["s"]%s}' % (sender, extra)),
                              "map<string,array<string>>")
        parts = F.array(F.struct(
            F.lit("1").alias("idx"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("filename"),
            F.lit(None).cast("string").alias("description"), F.lit(False).alias("is_container"),
            F.lit(body).alias("text"), F.lit(None).cast("binary").alias("body")))
        return one(spark, hashing.content_hash(headers, parts))

    base = digest("A B <a@X.Org>", "hi\n")
    assert base == digest('\\"A  B\\" <a@x.org>', "hi  \r\n\n")
    assert base != digest("A B <a@x.org>", "hello\n")
    assert base != digest("A B <a@x.org>", "hi\n", ',"references":["<r@x>"]')
    assert base == digest("A B <a@x.org>", "hi\n", ',"references":["<m@x>"]')


def test_quote_blocks(spark):
    body = "intro\n> a\n> b\nanswer\n\n>c"
    got = one(spark, text.quote_blocks(F.lit(body)))
    assert [(b.quoted, b.text) for b in got] == [
        (False, "intro\n"), (True, "> a\n> b\n"), (False, "answer\n\n"), (True, ">c\n")
    ]
    many = "".join(f"> line {i}\n" for i in range(20000))
    assert len(one(spark, text.quote_blocks(F.lit(many)))) == 1


def test_links(spark):
    value = "See http://a.org/x. (http://b.org/y). http://c.org/(z) 'https://d.org/q', http://e.org/p)"
    assert one(spark, text.links(F.lit(value))) == [
        "http://a.org/x", "http://b.org/y", "http://c.org/(z)", "https://d.org/q", "http://e.org/p",
    ]


def test_trailers(spark):
    ruby = "hi\n\nUnsubscribe: <mailto:ruby-core-request@ruby-lang.org?subject=unsubscribe>\n" \
           "<http://lists.ruby-lang.org/cgi-bin/mailman/options/ruby-core>\n"
    assert one(spark, text.without_trailer(F.lit(ruby), text.RUBY_TRAILER)) == "hi\n"
    assert one(spark, text.without_trailer(F.lit("plain\n"))) == "plain\n"


PATCH = """hello
---
 lib/x.c | 3 ++-
 {old => new}/y.c | 1 +

diff --git a/lib/x.c b/lib/x.c
index 1234567..89abcde 100644
--- a/lib/x.c
+++ b/lib/x.c
@@ -1,3 +1,3 @@ int main(void)
 same
-gone
+come
diff --git a/pic.png b/pic.png
new file mode 100644
index 0000000..fedcba9
GIT binary patch
literal 10
RcmZQzU|?imU}9ikU|?WiU|;|L0RSTa

literal 0
HcmV?d00001

-- 
1.0
"""


def test_diff_lines():
    kinds = [(k, v) for _, k, v in diffs.classify_lines(PATCH)]
    assert ("file", "lib/x.c") in kinds and ("file", "pic.png") in kinds
    assert [v for k, v in kinds if k == "added"] == ["come"]
    assert [v for k, v in kinds if k == "removed"] == ["gone"]
    assert [v for k, v in kinds if k == "context"] == ["same"]
    assert [v for k, v in kinds if k == "hunk"] == ["int main(void)"]
    assert [v for k, v in kinds if k == "post"] == ["89abcde", "fedcba9"]
    assert ("plain", "literal 10") in kinds and not any("RcmZ" in v for k, v in kinds if k == "plain")


def test_old_diffs_and_quoting():
    assert diffs.common_path("old/src/a.c", "new/src/a.c") == "src/a.c"
    assert diffs.common_path("a.c", "b.c") is None
    assert diffs.unquote('"a/\\303\\251\\t.c"') == "a/é\t.c"
    kinds = [(k, v) for _, k, v in diffs.classify_lines("--- x/a.c\n+++ y/a.c\n@@ -0,0 +1 @@\n+new\n+after")]
    assert kinds == [("file", "a.c"), ("added", "new"), ("plain", "+after")]


def test_diff_headers_and_stat(spark):
    got = one(spark, diffs.diff_headers(F.lit(PATCH)))
    assert [(h.pre, h.post, h.path_a, h.path_b) for h in got] == [("1234567", "89abcde", "lib/x.c", "lib/x.c")]
    bad = PATCH.replace("lib/x.c", "../x.c")
    assert one(spark, diffs.diff_headers(F.lit(bad))) == []
    assert [s.path for s in one(spark, diffs.diffstat(F.lit(PATCH)))] == ["lib/x.c", "new/y.c"]


def test_patch_key_ignores_space_and_line_numbers(spark):
    key = one(spark, diffs.patch_key(F.lit(PATCH)))
    moved = PATCH.replace("@@ -1,3 +1,3", "@@ -9,3 +9,3").replace("+come", "+ come")
    assert key == one(spark, diffs.patch_key(F.lit(moved)))
    assert key != one(spark, diffs.patch_key(F.lit(PATCH.replace("+come", "+else"))))
    assert one(spark, diffs.patch_key(F.lit("no patch"))) is None


@pytest.mark.parametrize(
    "word, want",
    [("consigned", "consign"), ("consistency", "consist"), ("knots", "knot"), ("hopping", "hop"), ("hoping", "hope"),
     ("relational", "relat"), ("cries", "cri"), ("ties", "tie"), ("gas", "gas"), ("generously", "generous"),
     ("skies", "sky"), ("agreed", "agre"), ("nationality", "nation"), ("café", "café"), ("by", "by")],
)
def test_stems(word, want):
    from archivelake.functions.stem import stem

    assert stem(word) == want
