"""Mails against a plain reader, Python's own decoders and cases written by hand."""

import base64
import quopri
import random
import re

from pyspark.sql import functions as F

from plumbline import query_mail
from plumbline.functions import mime
from plumbline.operators import mail


def one(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def texts():
    draw = random.Random(2)
    letters = "ab =\n\r\té東🎉%+&?~\"'<>\\$."
    return ["", "=", "==", "a=b", "100%", "+1 + 2", "é" * 900, "x" * 50_000] + ["".join(draw.choice(letters) for _ in range(draw.randrange(200))) for _ in range(60)]


def test_quoted_printable_equals_quopri(spark):
    coded = [quopri.encodestring(t.encode(), quotetabs=True).decode() for t in texts()]
    want = [quopri.decodestring(c.encode()).decode() for c in coded]
    assert one(spark, coded, mime.from_quoted_printable) == want
    # An = that starts no escape stays, and bytes that are no UTF-8 are replaced.
    assert one(spark, ["a=3", "a=zz", "=C3=28", "50% + =C3=A9", "cut=E2=82"], mime.from_quoted_printable) == ["a=3", "a=zz", "�(", "50% + é", "cut�"]


def test_base64_equals_the_library(spark):
    own = [t.encode() for t in texts()]
    coded = [base64.encodebytes(t).decode() for t in own]
    assert one(spark, coded, mime.from_base64) == [t.decode() for t in own]
    cut = [base64.b64encode(("tail " * 9 + "é").encode()).decode()[:n] for n in range(1, 40)]

    def plain(code):
        for c in (code, code[: len(code) // 4 * 4]):
            if len(c) % 4 != 1:
                return base64.b64decode(c + "=" * (-len(c) % 4)).decode("utf-8", "replace")

    assert one(spark, cut, mime.from_base64) == [plain(c) for c in cut]
    assert one(spark, ["! no base64", "====", "a===", "YQ==\n", "77u/YQ==", "/w=="], mime.from_base64) == ["! no base64", "====", "a===", "a", "a", "�"]


# -- a plain reader -------------------------------------------------------------------------
def opened(raw):
    found = re.search(r"\r?\n\r?\n", raw)
    return (raw, "") if not found else (raw[: found.start()], raw[found.end() :])


def value(head, name):
    found = re.search(rf"^{name}\s*:\s*(.*)$", re.sub(r"\r?\n[ \t]+", " ", head).replace("\r\n", "\n"), re.I | re.M)
    return found[1].strip() if found else ""


def mark_of(kind):
    found = re.search(r'boundary\s*=\s*"([^"]+)"', kind, re.I) or re.search(r"boundary\s*=\s*([^\s;]+)", kind, re.I)
    return found[1] if found else ""


def listing(raw, cut, path=()):
    """(path, type, complete) of the leaves; type None where the tree goes on below the tenth level."""
    if len(path) > 10:
        return [(path, None, None)]
    head, body = opened(raw)
    kind = value(head, "content-type")
    name = kind.split(";")[0].strip().lower()
    if name.startswith("multipart/") and mark_of(kind):
        pieces = body.split("--" + mark_of(kind))[1:]
        close = next((i for i, s in enumerate(pieces) if s.startswith("--")), None)
        pieces, out = pieces[:close], []
        for i, piece in enumerate(pieces):
            text, whole = re.sub(r"\A\r?\n", "", piece), not cut or close is not None or i < len(pieces) - 1
            if text.strip():
                out += listing(text, not whole, (*path, i + 1))
            elif not whole:
                out.append(((*path, i + 1), "", False))
        return out
    if name == "message/rfc822":
        return listing(body, cut, (*path, 1))
    return [(path, name, not cut)]


def grown(draw, depth=0):
    """A random mail: nested, attached, empty parts, odd boundaries, mixed line ends."""
    end = draw.choice(["\n", "\r\n"])
    if depth < 13 and draw.random() < (0.9 if depth < 3 else 0.75):
        if draw.random() < 0.15:
            return f"Content-Type: message/rfc822{end}{end}" + grown(draw, depth + 1)
        mark = draw.choice(["b", "b--", "a.b*c", "x\\Ey", "B b"]) + str(depth)
        parts = [grown(draw, depth + 1) if draw.random() < 0.9 else "" for _ in range(draw.randrange(1, 3))]
        closing = f"--{mark}--{end}after" if draw.random() < 0.9 else ""
        kind = draw.choice(["multipart/mixed", "Multipart/Alternative", "multipart/mixed; charset=x"])
        return f'Content-Type: {kind};{end} boundary="{mark}"{end}{end}before{end}' + "".join(f"--{mark}{end}{p}{end}" for p in parts) + closing
    return draw.choice([f"Content-Type: text/plain{end}{end}hello", f"X: y{end}{end}text", "no blank line", f"Content-Type: multipart/mixed{end}{end}x", f"Content-Type: TEXT/HTML; a=b{end}{end}<p>"])


def test_part_trees_equal_the_plain_reader(spark):
    draw = random.Random(8)
    mails = [(i, grown(draw), draw.random() < 0.4) for i in range(250)] + [(900, "", False), (901, "\n\n", True), (902, "x" * 300_000, False)]
    mails = [(i, m[: draw.randrange(len(m) + 1)] if c else m, c) for i, m, c in mails]
    df = spark.createDataFrame([*mails, (903, None, None)], "id int, mail string, cut boolean")
    got = sorted((r["id"], r["path"], r["type"], r["complete"]) for r in mail.parts(df, ["id"], cut=F.col("cut")).collect() if r["type"] is not None or r["depth"] <= 10)
    want = [(i, ".".join(map(str, p)), k, c) for i, m, cut in [*mails, (903, "", False)] for p, k, c in listing(m, cut) if k is not None]
    assert got == sorted(want)
    deep = {(r["id"], r["path"]) for r in mail.parts(df, ["id"], cut=F.col("cut")).filter("type IS NULL").collect()}
    assert deep == {(i, ".".join(map(str, p))) for i, m, cut in mails for p, k, _ in listing(m, cut) if k is None} and deep


def test_names_of_parts(spark):
    heads = ['Content-Disposition: attachment; filename="a b.pdf"', "Content-Type: text/plain; name=x.txt", "Content-Disposition: attachment;\n filename*=utf-8''na%C3%AFve.txt", "Content-Disposition: inline; filename=100%.txt", "Content-Type: text/plain"]
    assert one(spark, heads, mime.filename) == ["a b.pdf", "x.txt", "naïve.txt", "100%.txt", ""]


FORWARDS = [
    # An attached mail wins, at any depth.
    ('Content-Type: multipart/mixed; boundary=x\n\n--x\n\nnote\n--x\nContent-Type: multipart/mixed; boundary=y\n\n--y\nContent-Type: message/rfc822\n\nFrom: a@b.c\n\nhi\n--y--\n--x--', False, "attachment", "From: a@b.c\n\nhi"),
    # A quote, with and without what stands above it.
    ("From: v@h\n\nlook\n\n---------- Forwarded message ---------\nFrom: S <s@b.c>\nDate: now\n  folded\n\nPay now\nthanks", True, "inline", "From: S <s@b.c>\nDate: now\nfolded\n\nPay now\nthanks"),
    ("From: v@h\n\nlook\n\nBegin forwarded message:\n\n> From: S <s@b.c>\n> Subject: x\n> \n> Pay now", False, "inline", "From: S <s@b.c>\nSubject: x\n\nPay now\n\nlook\n\nBegin forwarded message:\n\n>"),
    # A header block without a separator keeps its first line.
    ("From: v@h\n\nsee\nFrom: S <s@b.c>\nSent: Monday\nSubject: y\nPay", True, "inline", "From: S <s@b.c>\nSent: Monday\nSubject: y\n\nPay"),
    # Without a sender there is no quote; a known forward then is its body, unless it was sent on whole.
    ("From: v@h\n\n-----Original Message-----\nSubject: x\n\nbody", True, "body", "-----Original Message-----\nSubject: x\n\nbody"),
    ("From: v@h\n\n-----Original Message-----\nSubject: x\n\nbody", False, "toplevel", None),
    ("Resent-From: v@h\nFrom: s@b.c\n\nPay", True, "toplevel", None),
    ("From: s@b.c\n\nPay", False, "toplevel", None),
    ("Content-Type: text/plain\nContent-Transfer-Encoding: base64\n\n" + base64.b64encode(b"--- Forwarded message ---\nReply-To: q@r\nPay").decode(), True, "inline", "Reply-To: q@r\n\nPay"),
    ("Content-Type: text/html\n\n<p>Hi</p><div>---- Forwarded message ----</div><p>From: S &lt;s@b.c&gt;</p><p>Pay <a href='http://x.y/z'>here</a></p>", True, "inline", "From: S <s@b.c>\n\nPay here http://x.y/z"),
]


def test_originals_of_forwards(spark):
    df = spark.createDataFrame([(i, raw, known) for i, (raw, known, _, _) in enumerate(FORWARDS)], "id int, mail string, known boolean")
    got = {r["id"]: (r["source"], r["original"]) for r in mail.unwrapped(df, ["id"], forwarded=F.col("known")).collect()}
    assert got == {i: (source, raw if original is None else original) for i, (raw, _, source, original) in enumerate(FORWARDS)}


def test_markup_starts_at_the_quote(spark):
    html = ['me<img src=own><div class="gmail_quote">q', "me <DIV ID=divRplyFwdMsg>q", "me<p>----- Forwarded message -----q", "me<p>From: S@B.c q", "nothing"]
    assert one(spark, html, lambda h: mime.trimmed(mail.quoted_markup(h, F.lit("s@b.c")))) == ['<div class="gmail_quote">q', "<DIV ID=divRplyFwdMsg>q", "----- Forwarded message -----q", "S@B.c q", ""]


HTML = [
    ("<style>a</style>x<!-- c -->y", "xy"), ("<stylex>a", "a"), ("<a href='u'>t</a>", "t u"), ("<a name=n>t</a>!", "t!"), ("<abbr>t</abbr>", "t"), ("a<br/>b<BR>c", "a\nb\nc"), ("<p>a  </p><p></p><p></p><p>b</p>", "a\n\nb"),
    ("&amp;lt; &lt;b&gt; &#39;&nbsp;x", "&lt; <b> ' x"), ("open <b unclosed", "open <b unclosed"), ("<script>if (a < b) {}</script>z", "z"), ("<a href=u>no end", "no end"), ("", ""), ("<head>h</head><header>k</header>", "k"),
]


def test_readable_html(spark):
    assert one(spark, [h for h, _ in HTML], mime.readable) == [t for _, t in HTML]
    assert one(spark, ["<a href='u'>t</a> http://x.y"], lambda h: mime.readable(h, "redact")) == ["t [scam link removed] http://x.y"]


def test_containers_without_parts_keep_their_row(spark):
    df = spark.createDataFrame([(1, "Content-Type: multipart/mixed; boundary=x\n\n"), (2, "a\n\nb")], "id int, mail string")
    assert [r["id"] for r in mail.parts(df, ["id"]).collect()] == [2]
    assert {(r["id"], r["plain"]) for r in mail.texts(df, ["id"]).collect()} == {(1, ""), (2, "b")}
    assert {(r["id"], r["source"]) for r in mail.unwrapped(df, ["id"]).collect()} == {(1, "toplevel"), (2, "toplevel")}


def test_empty_table(spark):
    none = query_mail.mails(spark.createDataFrame([], "doc_id bigint, text string"))
    for found in (mail.parts(none, ["doc_id"], cut=F.col("cut")), mail.texts(none, ["doc_id"]), mail.unwrapped(none, ["doc_id"], forwarded=F.col("forwarded")), mail.distilled(none, ["doc_id"])):
        assert found.collect() == []


def test_every_shape_of_mail_is_read_back(spark):
    """Whole texts come back out of each encoding, with white space, marks and signs of every kind."""
    own = [(i, t) for i, t in enumerate(texts() * 2)]
    docs = spark.createDataFrame(own, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in mail.texts(query_mail.mails(docs), ["doc_id"]).collect()}
    for i, t in own:
        shape = query_mail.SHAPES[i % 10]
        if shape in ("escaped", "body", "plain", "resent") or shape == "nested" and i % 12 <= 10:
            assert got[i]["plain"] == t, (i, shape)
        if shape in ("coded html", "cut"):
            assert got[i]["html"] == t, (i, shape)
        assert got[i]["too_deep"] == (shape == "nested" and i % 12 == 11)


def test_parts_of_a_mail_stay_in_their_task(spark):
    """The tree needs no exchange of rows."""
    df = spark.createDataFrame([(1, "x")], "id int, mail string")
    plan = mail.parts(df, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan




def test_mails_are_read_without_moving_them_and_ids_may_repeat(spark):
    """Parts stay in the row of their mail; before, rows were grouped by id, so repeated ids were mixed up."""
    df = spark.createDataFrame([(1, "a: b\n\nfirst"), (1, "a: b\n\nsecond"), (2, None)], "id int, mail string")
    found = mail.texts(df, ["id"])
    assert sorted(tuple(r) for r in found.collect()) == [(1, "first", "", "", 0), (1, "second", "", "", 0), (2, "", "", "", 0)]
    for rows in (found, mail.unwrapped(df, ["id"]), mail.distilled(df, ["id"])):
        assert "Exchange" not in rows._jdf.queryExecution().sparkPlan().toString() and "Aggregate" not in rows._jdf.queryExecution().sparkPlan().toString()


def test_heads_end_at_the_first_blank_line(spark):
    raws = ["a\n\nb\n\nc", "a\r\n\r\nb", "a\n\r\nb", "a\r\n\nb", "\n\nb", "é🎉\n\n🎉b", "no blank\nline", "", "a\n\n", None, "x\r\r\n\n\nb"]
    assert one(spark, raws, mime.head_and_body) == one(spark, raws, lambda v: F.split(v, mime.BLANK_LINE, 2))[:9] + [[None]] + [["x\r", "\nb"]]


def test_trimming_takes_every_white_space(spark):
    texts = [" \t\n\x0b\f\ra b\r\f\x0b\n\t ", " a ", "", " \n ", None, "é🎉 "]
    assert one(spark, texts, mime.trimmed) == one(spark, texts, lambda v: F.regexp_replace(v, r"\A\s+|\s+\z", ""))
