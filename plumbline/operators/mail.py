"""Mails as rows: the tree of parts, what of it arrived, the texts, and the original of a forward.

A level of the tree is one step: nodes that hold other parts become them, as rows in ``parts`` and within
an array of the mail's row in ``texts``, and leaves go on as they are.  The steps follow one another without
a shuffle, so a mail's parts stay in the task that read it.  A node below the tenth level is a row of its own, marked as too deep; nothing is lost in silence.

Two ways to cut a container differ as readers do.  ``parts`` lists what a mail holds, stops at the closing
delimiter, looks into attached mails and says of each leaf whether it arrived whole.  ``texts`` takes
every segment, leaves attached mails shut and finds the first plain text, HTML and attached mail.

Defined cases: a null mail counts as empty; an empty mail is one part without a type; a container without a boundary is a leaf
of the list and has no text; rows that repeat an id are told apart by their row; an empty table gives no rows; texts
of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mime

#: Levels below the mail itself that are opened.
DEPTH = 10


def _node(path: Column, raw: Column, cut: Column, leaf: Column) -> Column:
    return F.struct(path.alias("path"), raw.alias("raw"), cut.alias("cut"), leaf.alias("leaf"))


def _listed(pieces: Column, cut: Column, path: Column) -> Column:
    """Children of a container as they arrived; an empty last piece of a cut mail is a part that had just begun."""
    own = F.slice(pieces, 2, F.size(pieces))
    closing = F.array_position(F.transform(own, lambda s: s.startswith("--")), True)
    parts = F.when(closing > 0, F.slice(own, F.lit(1), (closing - 1).cast("int"))).otherwise(own)

    def child(text: Column, i: Column) -> Column:
        whole = ~cut | (closing > 0) | (i < F.size(parts) - 1)
        return _node(F.concat(path, F.array(i + 1)), F.regexp_replace(text, r"\A\r?\n", ""), ~whole, F.lit(False))

    return F.transform(F.filter(F.transform(parts, child), lambda n: n["raw"].rlike(r"\S") | n["cut"]), lambda n: _node(n["path"], n["raw"], n["cut"], ~n["raw"].rlike(r"\S")))


def _level(df: DataFrame, keys: list[str]) -> DataFrame:
    """One step down: containers become their parts; a container without any leaves a row without a path."""
    open_ = ~F.coalesce(F.col("node.leaf"), F.lit(True))
    df = df.withColumn("cuts", F.when(open_, mime.head_and_body(F.col("node.raw"))))
    df = df.withColumn("body", F.coalesce(F.get("cuts", F.lit(1)), F.lit(""))).withColumn("content_type", F.when(open_, mime.header(F.get("cuts", F.lit(0)), "content-type")))
    df = df.withColumn("kind", F.lower("content_type"))
    df = df.withColumn("mark", F.when(F.col("kind").startswith("multipart/"), mime.boundary(F.col("content_type"))).otherwise(""))
    path, cut = F.col("node.path"), F.col("node.cut")
    pieces = mime.segments(F.col("body"), F.col("mark"))
    own = F.array(_node(path, F.col("node.raw"), cut, F.lit(True)))
    attached = mime.trimmed(F.split("kind", ";")[0]) == "message/rfc822"
    within = F.when(F.col("mark") != "", _listed(pieces, cut, path)).when(attached, F.array(_node(F.concat(path, F.array(F.lit(1))), F.col("body"), cut, F.lit(False))))
    return df.select(*keys, F.explode_outer(within.otherwise(own)).alias("node"))


def leaves(mails: DataFrame, keys: list[str], mail: str = "mail", cut: Column | None = None) -> DataFrame:
    """The keys with path, depth, too_deep, cut, head and body of every leaf of the tree; where a container
    has no parts, a row whose path is null."""
    start = _node(F.array().cast("array<int>"), F.coalesce(F.col(mail).cast("string"), F.lit("")), F.lit(False) if cut is None else F.coalesce(cut, F.lit(False)), F.lit(False))
    df = mails.select(*keys, start.alias("node"))
    for _ in range(DEPTH + 1):
        df = _level(df, keys)
    df = df.withColumn("cuts", mime.head_and_body(F.col("node.raw")))
    # Only nodes below the last level that is opened are not yet known to be leaves.
    return df.select(*keys, F.col("node.path").alias("path"), F.size("node.path").alias("depth"), ((F.size("node.path") > DEPTH) & ~F.col("node.leaf")).alias("too_deep"), F.col("node.cut").alias("cut"), F.get("cuts", F.lit(0)).alias("head"), F.coalesce(F.get("cuts", F.lit(1)), F.lit("")).alias("body"))


def parts(mails: DataFrame, keys: list[str], mail: str = "mail", cut: Column | None = None) -> DataFrame:
    """path, depth, type, filename and complete of every part; what is too deep has null for the last three."""
    found = leaves(mails, keys, mail, cut).filter("path IS NOT NULL")
    kind = F.lower(mime.trimmed(F.split(mime.header(F.col("head"), "content-type"), ";")[0]))
    known = lambda c: F.when(~F.col("too_deep"), c)
    return found.select(*keys, F.array_join(F.transform("path", lambda i: i.cast("string")), ".").alias("path"), "depth", known(kind).alias("type"), known(mime.filename(F.col("head"))).alias("filename"), known(~F.col("cut")).alias("complete"))


def _opened(nodes: Column) -> Column:
    """One step down for an array of nodes (raw, leaf), each replaced in place by its parts or by itself as a leaf."""
    node = lambda raw, leaf: F.struct(raw.alias("raw"), F.lit(leaf).alias("leaf"))
    clean = lambda s: F.regexp_replace(F.regexp_replace(s, r"\A\r?\n", ""), r"\r?\n--\s*\z", "")

    def parts_of(raw: Column, cuts: Column, kind: Column) -> Column:
        within = F.filter(F.transform(mime.segments(F.coalesce(F.get(cuts, F.lit(1)), F.lit("")), mime.boundary(kind)), clean), lambda s: s.rlike(r"\S") & ~s.rlike(r"\A\s*--\s*\z"))
        return F.when(F.lower(kind).startswith("multipart/") & (mime.boundary(kind) != ""), F.transform(within, lambda s: node(s, False))).otherwise(F.array(node(raw, True)))

    def one(n: Column) -> Column:
        opened = mime.bound(mime.head_and_body(n["raw"]), lambda cuts: mime.bound(mime.header(F.get(cuts, F.lit(0)), "content-type"), lambda kind: parts_of(n["raw"], cuts, kind)))
        return F.when(n["leaf"], F.array(n)).otherwise(opened)

    # Most mails have no more to open after few steps.
    return F.when(F.exists(nodes, lambda n: ~n["leaf"]), F.flatten(F.transform(nodes, one))).otherwise(nodes)


def _known(n: Column) -> Column:
    """A node after the last step as kind and text: deep, html, plain, attached or null, and its decoded text."""
    def told(cuts: Column, kind: Column) -> Column:
        head, body = F.get(cuts, F.lit(0)), F.coalesce(F.get(cuts, F.lit(1)), F.lit(""))
        name = F.when(~n["leaf"], "deep").when(kind.startswith("text/html"), "html").when(kind.startswith("text/plain") | (kind == ""), "plain").when(kind.startswith("message/rfc822"), "attached")
        text = F.when(name == "attached", mime.trimmed(body)).when(name.isin("html", "plain"), mime.decoded(body, mime.header(head, "content-transfer-encoding")))
        return F.struct(name.alias("kind"), text.alias("text"))

    return mime.bound(mime.head_and_body(n["raw"]), lambda cuts: mime.bound(F.lower(mime.header(F.get(cuts, F.lit(0)), "content-type")), lambda kind: told(cuts, kind)))


def texts(mails: DataFrame, keys: list[str], mail: str = "mail", carried: tuple[str, ...] = ()) -> DataFrame:
    """plain, html and attached of each mail: the first of each kind that is not empty, else ''; and
    too_deep, how many nodes were below the tenth level.  Columns ``carried`` come along.

    A mail's nodes are an array of its row, in the order of the tree, so nothing is moved and ``keys`` may repeat.
    """
    start = F.array(F.struct(F.coalesce(F.col(mail).cast("string"), F.lit("")).alias("raw"), F.lit(False).alias("leaf")))
    df = mails.select(*keys, *carried, start.alias("nodes"))
    opened = _opened(F.col("nodes")).alias("nodes")
    for _ in range(DEPTH + 1):
        df = df.select(*keys, *carried, opened)
    df = df.select(*keys, *carried, F.transform("nodes", _known).alias("nodes"))
    first = lambda kind: F.coalesce(F.get(F.filter("nodes", lambda n: (n["kind"] == kind) & (n["text"] != "")), F.lit(0))["text"], F.lit("")).alias(kind)
    return df.select(*keys, *carried, first("plain"), first("html"), first("attached"), F.size(F.filter("nodes", lambda n: n["kind"] == "deep")).cast("bigint").alias("too_deep"))


# -- forwards -------------------------------------------------------------------------------
#: Lines that mail programs write above a forwarded mail, and header blocks that others write instead; fixed values.
SEPARATORS = (r"(?i)(?<!-)-{2,}\s*forwarded message\s*-{2,}", r"(?i)begin forwarded message:", r"(?i)(?<!-)-{2,}\s*original message\s*-{2,}")
HEADER_BLOCKS = (r"(?im)^[ \t>]*from:\s[^\n]*\bsent:\s", r"(?im)^[ \t>]*from:\s[^\n]*\n[ \t>]*sent:\s")
QUOTED_HEADERS = ("from", "to", "cc", "reply-to", "sent", "date", "subject", "disposition-notification-to", "return-receipt-to", "x-confirm-reading-to")
#: Marks by which mail programs wrap a quoted mail in HTML.
QUOTE_MARKS = ('class="gmail_quote', 'id="divrplyfwdmsg"', "id=divrplyfwdmsg", 'type="cite"')


def _first(text: Column, patterns: tuple[str, ...]) -> Column:
    """Where the earliest match of some patterns starts, from 1; null where none matches."""
    at = [F.nullif(F.regexp_instr(text, F.lit(p)), F.lit(0)) for p in patterns]
    return F.least(*at) if len(at) > 1 else at[0]


def _rest(text: Column, at: Column) -> Column:
    return F.substring(text, at, F.length(text))


def quoted(df: DataFrame, text: str) -> DataFrame:
    """Adds ``inline``, the mail that a text quotes below the mark of a forward: its headers, a blank
    line, its body; '' where no mark or no sender is found.

    Lines below the mark lose their quote signs.  The block of headers goes from the first line that is not
    blank to the first that is blank or looks like no header.
    """
    own, block = _first(F.col(text), SEPARATORS), _first(F.col(text), HEADER_BLOCKS)
    df = df.withColumn("own_at", own).withColumn("block_at", block).withColumn("at", F.least("own_at", "block_at"))
    lines = F.split(_rest(F.col(text), F.col("at")), r"\r?\n")
    # A separator is a line to leave out; a header block starts with the sender.
    is_block = F.col("own_at").isNull() | (F.col("block_at") < F.col("own_at"))
    lines = F.when(is_block, lines).otherwise(F.slice(lines, 2, F.size(lines)))
    df = df.withColumn("lines", F.transform(lines, lambda s: F.regexp_replace(s, r"\A\s*>+\s?", "")))
    df = df.withColumn("first", F.array_position(F.transform("lines", lambda s: s.rlike(r"\S")), True))
    known = rf"(?i)\A(?:{'|'.join(QUOTED_HEADERS)})\s*:"

    def ends(line: Column, i: Column) -> Column:
        more = line.rlike(r"\A\s+\S") | line.rlike(r"\A[A-Za-z][A-Za-z0-9-]*\s*:\s")
        return (i + 1 >= F.col("first")) & ~F.when(i + 1 == F.col("first"), line.rlike(known)).otherwise(line.rlike(r"\S") & (line.rlike(known) | more))

    df = df.withColumn("stop", F.array_position(F.transform("lines", ends), True))
    df = df.withColumn("stop", F.when((F.col("first") > 0) & (F.col("stop") > 0), F.col("stop")).otherwise(F.size("lines") + 1).cast("int"))
    heads = F.transform(F.filter(F.slice("lines", F.lit(1), F.col("stop") - 1), lambda s: s.rlike(r"\S")), mime.trimmed)
    df = df.withColumn("heads", heads)
    body = F.slice("lines", F.col("stop"), F.greatest(F.size("lines") - F.col("stop") + 1, F.lit(0)))
    # A blank line that ends the block is no part of the body; trimming takes it away.
    df = df.withColumn("body", mime.trimmed(F.array_join(body, "\n")))
    sender = F.exists("heads", lambda s: s.rlike(r"(?i)\A(?:from|reply-to)\s*:"))
    whole = F.concat(F.array_join("heads", "\n"), F.when(F.col("body") != "", F.concat(F.lit("\n\n"), "body")).otherwise(""))
    df = df.withColumn("inline", F.coalesce(F.when(F.col("at").isNotNull() & sender, whole), F.lit("")))
    return df.withColumn("inline_first", F.coalesce(F.get("heads", F.lit(0)), F.lit(""))).drop("own_at", "block_at", "at", "lines", "first", "stop", "heads", "body")


def _sender(original: Column) -> Column:
    """The address in the From header, else in Reply-To, in lower case."""
    head = F.get(mime.head_and_body(original), F.lit(0))
    value = F.coalesce(F.nullif(mime.header(head, "from"), F.lit("")), mime.header(head, "reply-to"))
    within = F.regexp_extract(value, "<([^>]*)>", 1)
    return F.lower(mime.trimmed(F.when(value.rlike("<[^>]*>"), within).otherwise(value)))


def quoted_markup(html: Column, sender: Column) -> Column:
    """HTML from where the quoted mail starts: the earliest mark of a forward or of a quote, else the sender's address; else ''."""
    low = F.lower(html)

    def opened(mark: str) -> Column:
        at = F.nullif(F.locate(mark, low), F.lit(0))
        before = F.reverse(F.substring(low, F.lit(1), at))
        return F.when(at.isNotNull(), F.greatest(at + 1 - F.nullif(F.locate("<", before), F.lit(0)), F.lit(1)))

    # A mark without a tag around it counts from the start.
    marks = [F.when(F.locate(m, low) > 0, F.coalesce(opened(m), F.lit(1))) for m in QUOTE_MARKS]
    at = F.least(_first(html, SEPARATORS), *marks)
    named = F.when(sender != "", F.nullif(F.position(sender, low), F.lit(0)))
    start = F.coalesce(at, named)
    return F.coalesce(_rest(html, start), F.lit(""))


def unwrapped(mails: DataFrame, keys: list[str], mail: str = "mail", forwarded: Column | None = None) -> DataFrame:
    """source, original and markup of each mail: the mail that matters inside one that may be a forward.

    ``attachment``: an attached mail, as it is.  ``inline``: a mail quoted in the decoded text; unless
    the outer mail is known to be a ``forwarded`` one, what stands above the quote goes along
    behind it, so that a quote planted below a scam hides nothing.  ``body``: the decoded text of a known
    forward without either.  ``toplevel``: the mail itself, also when it was sent on with its headers whole.
    """
    known = F.coalesce(forwarded, F.lit(False)) if forwarded is not None else F.lit(False)
    rows = mails.select(*keys, F.coalesce(F.col(mail).cast("string"), F.lit("")).alias("raw"), known.alias("known"))
    found = texts(rows, keys, "raw", ("raw", "known"))
    found = found.withColumn("text", F.when(F.col("plain").rlike(r"\S"), F.col("plain")).otherwise(F.when(F.col("html") != "", mime.readable(F.col("html"))).otherwise("")))
    found = quoted(found, "text")
    above = mime.trimmed(F.substring(F.col("text"), F.lit(1), F.position("inline_first", "text") - 1))
    inline = F.when(F.col("known") | (above == ""), F.col("inline")).otherwise(F.concat("inline", F.lit("\n\n"), above))
    resent = F.get(mime.head_and_body(F.col("raw")), F.lit(0)).rlike(r"(?im)^resent-(?:from|sender)\s*:")
    source = F.when(F.col("attached") != "", "attachment").when(F.col("inline") != "", "inline").when(F.col("known") & ~resent, "body").otherwise("toplevel")
    found = found.withColumn("source", source)
    original = F.when(F.col("source") == "attachment", F.col("attached")).when(F.col("source") == "inline", inline).when(F.col("source") == "body", mime.trimmed(F.col("text"))).otherwise(F.col("raw"))
    quote = F.when(F.col("html") != "", quoted_markup(F.col("html"), _sender(F.col("inline")))).otherwise("")
    markup = F.when((F.col("source") == "inline") & F.col("known"), quote).otherwise(F.col("html"))
    found = found.select(*keys, "source", original.alias("original"), markup.alias("markup"))
    # An attached mail has a tree of its own.
    inner = found.withColumn("inner", F.when(F.col("source") == "attachment", F.col("original")).otherwise(""))
    found = texts(inner, keys, "inner", ("source", "original", "markup"))
    return found.select(*keys, "source", "original", F.when(F.col("source") == "attachment", F.col("html")).otherwise(F.col("markup")).alias("markup"))


#: Headers that a reader is shown, in order.
SHOWN = ("From", "Reply-To", "To", "Subject", "Date")


def distilled(mails: DataFrame, keys: list[str], mail: str = "mail") -> DataFrame:
    """``shown``: a few headers and the readable body of the mail that matters, without its links."""
    original = unwrapped(mails, keys, mail).select(*keys, "original")
    found = texts(original, keys, "original", ("original",))
    head = F.get(mime.head_and_body(F.col("original")), F.lit(0))
    line = lambda name: F.nullif(mime.header(head, name), F.lit(""))
    lines = F.array_join(F.array_compact(F.array(*(F.concat(F.lit(f"{name}: "), line(name)) for name in SHOWN))), "\n")
    html = F.when(F.col("html") != "", mime.without_links(mime.readable(F.col("html"), "redact"))).otherwise("")
    body = mime.trimmed(F.when(F.col("plain").rlike(r"\S"), mime.without_links(mime.trimmed(F.col("plain")))).otherwise(html))
    both = found.select(*keys, "original", lines.alias("lines"), body.alias("body"))
    shown = F.array_join(F.array_compact(F.array(F.nullif("lines", F.lit("")), F.nullif("body", F.lit("")))), "\n\n")
    return both.select(*keys, F.when(shown != "", shown).otherwise(mime.trimmed(F.col("original"))).alias("shown"))
