"""The message rules: signals found once per text, rules over signals, scores over rules.

Signals are patterns over the folded text, rules are conditions over signals with points, and both are plain
columns: a first projection finds the signals, a second one weighs the rules, a third adds up.  No
array is searched twice and no Python runs.  A region's pack supplies lists and switches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lexicon
from ..dialect import INVISIBLE, MARKED, PLAIN, SPARK, Spark, _spelled, folded, lettered

LINK = r"https?://[^\s]+"
#: A promise not to ask, or advice not to give, within 40 characters: it excuses its own clause only.
NEGATED = r"\b(?:never|do not|don.t|will not|won.t|not)\b.{0,40}?\b(?:ask|share|send|give|tell)"
#: Where a clause ends: at a stop, at a word that turns, and at a comma behind which a new request starts.
CLAUSE_END = r"[.!?;\n]+|\b(?:but|however|though|although|and then)\b"
NEW_REQUEST = r",\s*((?:please\s+|just\s+|kindly\s+|then\s+)?(?:ask|share|send|give|tell|reply|enter|confirm|update|verify|pay|click|call|provide|forward)\b)"
#: Numbers to call, written in any way: not the digits of a price, a date or a longer code.
CALLABLE = r"(?:^|[^A-Za-z0-9.,$£€/-])\+?\(?[0-9][0-9 ().-]{4,18}[0-9](?:$|[^A-Za-z0-9/-])"
CALL = r"\b(?:call|ring|phone|dial)\b"
NUMBER = r"\+[0-9][0-9 ().-]{6,18}[0-9]"


@dataclass(frozen=True)
class MessageRule:
    """``deferred`` points count beside other evidence only; ``full`` rules escape an outer discount."""

    rule_id: str
    condition: str
    points: str
    deferred: int = 0
    full: bool = False


def signals(d: Spark, region: str | None) -> dict[str, str]:
    """name -> expression over ``raw`` (the text), ``t`` (folded), ``s`` (folded, without negated clauses)."""
    p = lexicon.pack(region)
    hit = lambda name, column="t": d.has(column, d.phrases(p[name]))
    many = lambda name, column="t": d.distinct(column, d.phrases(p[name]))
    word = lambda regex, column="t": d.has(column, regex)
    legit = "|".join(x.replace(".", "\\.") for x in p["legit"])
    no_legit = d.replace("t", rf"https?://(?:[a-z0-9-]+\.)*(?:{legit})(?:[/?#:][^\s]*)?(?:\s|$)") if legit else "t"
    brands = "|".join(p["brands"])
    no_own = d.replace("t", rf"https?://(?:[a-z0-9-]+\.)*(?:{brands})\.(?:com|net|org|co\.uk|com\.au)(?:[/?#:][^\s]*)?(?:\s|$)")
    return {
        "n_urgency": many("urgency"), "n_reward": many("reward"), "n_claim": d.count("t", r"\bclaim(?:s|ed|ing)?\b"),
        "n_claim_noun": d.count("t", r"\b(?:insurance|warranty|the|a|this|that)\s+claim\b"), "n_ask": many("ask", "s"), "n_service": many("service", "s"),
        "coaching": hit("coaching"), "family": word(r"^(?:hi|hey|hello)\s+" + d.phrases(p["family"])), "money_ask": hit("money_ask"), "pretext": hit("pretext"),
        "fee": word(r"\b(?:fee|charge|postage|levy)\b"), "amount": f"coalesce(TRY_CAST({d.extract('t', '[$£€]\\s?([0-9]+(?:[.][0-9]{1,2})?)', 1)} AS DOUBLE), 0.0)",
        "fix_address": word(r"\b(?:update|confirm|correct)\s+(?:your\s+)?(?:delivery\s+)?address\b"), "delivery": word(r"\b(?:delivery|parcel|package|courier|post)\b"),
        "rental": word(r"\b(?:rent|rental|apartment|landlord|lease)\b"), "keys_by_post": hit("keys_by_post"), "deposit": word(r"\bdeposit\b"), "bank": word(r"\b(?:bank\s+details|account\s+number|account\s+details|bsb|iban)\b", "s"),
        "benefit": word(r"\b(?:eligible\s+for|entitled\s+to)\b[^.]*\b(?:grant|benefit|rebate|payment)\b"), "changed": word(r"\b(?:payment|bank|account)\s+details\s+(?:have\s+)?changed\b"),
        "settlement": word(r"\b(?:settlement|trust\s+account|conveyanc)"), "redirect": word(r"\bnew\s+(?:trust\s+)?account\b|\baccount\s+details\s+have\s+changed\b"), "protective": word(r"\b(?:have\s+not\s+changed|never\s+call|call\s+us\s+before|use\s+the\s+app|do\s+not\s+share)\b"),
        "link": word(r"https?://|\bwww\."), "link_host": d.extract("t", r"https?://([^\s/:?#]+)", 1), "plain_http": word(r"^[^:]*http://|http://"),
        "reply_trick": word(r"\breply\s+(?:y|yes|1)\b[^.]*\b(?:reopen|activate|link|exit)"), "qr": word(r"\bscan\s+(?:the|this)\s+(?:qr\s+)?code\b"), "voicemail": word(r"\bnew\s+voice\s?mail\b|\blisten\s+to\s+your\s+(?:voice\s+)?message"),
        "run_dialog": word(r"win(?:dows)?\s?(?:key\s?)?\+\s?r\b"), "terminal": word(r"\b(?:terminal|powershell|command\s+prompt)\b"), "paste": word(r"\bpaste\b"), "unverified": word(r"\bunverified\s+sender\b|\bnot\s+protected\s+by\s+the\s+sender\s+register\b"),
        "n_jobs": many("jobs"), "tasks": word(r"\b(?:task|earning|commission)s?\b"), "unlock": word(r"\b(?:deposit|top\s+up|recharge|pay)\b[^.]*\b(?:withdraw|unlock|release)|\bunlock\b[^.]*\bdeposit\b"),
        "code_ask": word(r"\b(?:send|give|tell|forward|read)\s+(?:me|us)\b[^.]*\b(?:code|otp)\b", "s"), "chat_status": word(r"\b(?:whatsapp|telegram)\s+account\s+will\s+be\s+(?:banned|deleted|suspended)\b"),
        "winnings": word(r"\b(?:verify|verification)\b[^.]*\b(?:winnings|jackpot|prize)\b|\b(?:winnings|jackpot)\b[^.]*\bverif"), "recovered": word(r"\brecover(?:ed|y)\b[^.]*\bfunds?\b"), "release_fee": word(r"\brelease\s+fee\b|\bpay\b[^.]*\bfee\b"),
        "n_investment": many("investment"), "crypto": hit("crypto"), "authority": hit("authority"), "no_link_sender": hit("no_link_senders"), "unofficial_link": d.has(no_legit, r"https?://|\bwww\."), "outlandish": hit("foreign_authority"),
        "chat_app": word(r"\b(?:whatsapp|telegram)\b"), "add_us": word(r"\b(?:add|contact|message)\s+(?:us|me)\b"), "brand": hit("brands"), "glued": d.has(no_own, rf"https?://[^\s/]*(?:{brands})"),
        "billed": word(r"\b(?:renewed|charged|billed|withdrawal\s+was\s+requested)\b"), "disown": word(r"\bif\s+you\s+did\s+not\b|\bnot\s+you\b"), "call": word(CALL), "phone": d.has("t", CALLABLE), "call_us": word(r"\b(?:call|ring|phone)\s+(?:us|now|on)\b"),
        "exchange": hit("exchanges"), "misspelt": hit("misspelt"), "platform": hit("platforms"), "reregister": hit("reregistration") + " OR " + word(r"\bre-register\s+your\s+identity\b"),
        "spliced": d.has("raw", r"[A-Za-z][\x{0370}-\x{04FF}]|[\x{0370}-\x{04FF}][A-Za-z]"), "n_foreign_letters": d.count("raw", r"[\x{0370}-\x{1FFF}\x{3040}-\x{9FFF}]"), "n_latin_letters": d.letters("raw", "[A-Za-z]"),
        "shortened": " OR ".join(f"link_host = '{h}'" for h in lexicon.SHORTENERS), "abused": d.has("link_host", r"\.(?:" + "|".join(lexicon.ABUSED_TLDS) + ")$"),
    }


#: A region's switches, the only thing besides its lists by which rules differ.
SWITCHES = ("unverified_sender", "chat_authority")


def rules(region: str | None, channel: str = "sms", by_row: bool = False) -> list[MessageRule]:
    """The rules over signals; ``callback`` silences two weaker ones.  In mail, where a message's points
    count for less, these composites keep their full weight.  ``by_row``: switches are columns on_..."""
    flags = lexicon.pack(region)["flags"]
    on = lambda flag: f"on_{flag}" if by_row else "TRUE" if flag in flags else "FALSE"
    R = MessageRule
    hits = "n_reward - CASE WHEN n_claim > 0 AND n_claim = n_claim_noun THEN 1 ELSE 0 END"
    callback = "billed AND disown AND call AND NOT link AND NOT protective AND phone"
    return [
        R("spliced_words", "spliced AND NOT n_foreign_letters > n_latin_letters" if channel != "email" else "FALSE", "25", full=True),
        R("urgency", "n_urgency > 0", "least(10 * n_urgency, 35)"), R("coaching", "coaching", "30"),
        R("small_fee", "fee AND amount > 0 AND amount <= 20", "20"), R("fix_address", "fix_address AND delivery", "20"),
        R("reward", f"{hits} > 0", f"least(12 * ({hits}), 40)"), R("sensitive_ask", "n_ask > 0", "least(15 * n_ask + 15 * n_service, 50)"),
        R("rental", "rental AND bank", "25"), R("keys_by_post", "keys_by_post AND (deposit OR bank)", "15"), R("benefit", "benefit AND (link OR n_ask > 0 OR bank)", "25"),
        R("family", "family AND money_ask AND pretext", "45", full=True), R("details_changed", "changed AND bank", "20"), R("settlement", "settlement AND redirect AND NOT protective", "25", full=True),
        R("link", "link", "15"), R("risky_link", "link AND (CASE WHEN shortened THEN 40 ELSE 0 END + CASE WHEN abused THEN 30 ELSE 0 END + CASE WHEN glued THEN 45 ELSE 0 END + CASE WHEN plain_http THEN 15 ELSE 0 END) > 40", "20"),
        R("reply_trick", "reply_trick", "25"), R("qr", "qr", "20"), R("voicemail", "voicemail", "20"),
        R("run_dialog", "run_dialog AND paste", "50", full=True), R("terminal", "terminal AND paste AND NOT run_dialog", "50", full=True),
        R("unverified_sender", f"{on('unverified_sender')} AND unverified", "35"), R("jobs", "n_jobs >= 2", "25"), R("task_payment", "tasks AND unlock", "40", full=True),
        R("code_harvest", "code_ask", "45"), R("chat_status", "chat_status", "30", full=channel == "email"), R("winnings", "winnings", "40"), R("recovered_funds", "recovered AND release_fee", "35"),
        R("investment", "n_investment >= 2 OR (n_investment >= 1 AND crypto)", "30"), R("authority", "authority AND (NOT link OR unofficial_link)", "0", deferred=25),
        R("no_link_sender", "authority AND no_link_sender AND link AND unofficial_link", "15"), R("authority_in_chat", f"{on('chat_authority')} AND authority AND chat_app AND add_us", "30"),
        R("foreign_authority", "outlandish", "35"), R("brand_glued", "brand AND glued", "20"), R("brand", "brand AND NOT glued", "0", deferred=20),
        R("callback", callback, "30", full=channel == "email"), R("asks_to_call", f"call_us AND phone AND NOT ({callback})", "20"), R("exchange_call", f"exchange AND phone AND call AND NOT link AND NOT ({callback})", "30"),
        R("misspelt", "misspelt", "10"), R("fake_platform", "platform", "50"), R("reregistration", "reregister", "25"),
    ]


#: Look-alike letters, wide digits and marks, and what they stand for; fixed values.
LOOK_ALIKES = ("\u0430\u0435\u043e\u0440\u0441\u0443\u0445\u0456" + "".join(chr(0xFF10 + i) for i in range(10)) + "\u2010\u2011\u2012\u2013\u2014\u2018\u2019\u201c\u201d", "aeopcyxi0123456789-----\u0001\u0001\u0002\u0002")
#: What mail and message programs put before a text that is sent on.
FORWARDING = r"^(?:\s*(?:-{2,}\s*(?:forwarded|original) message\s*-{2,}|begin forwarded message:|>+))+\s*"

#: Links made harmless, dots in brackets, dots behind a host, and runs of blanks.
HARMLESS, BRACKETED, LAST_DOTS, BLANKS = r"hxxp(s?)(?:\[:\]|:)//", r"\[[.]\]|\([.]\)", r"(https?://[^\s/?#]*[^\s/?#.])[.]+([/?#]|\s|$)", r"[ \t]{2,}"


def readable(d: Spark, column: str) -> str:
    """The folded text as a reader takes it: look-alikes as plain letters, blanks and marks of one kind, links
    that were made harmless as they were, hosts without a last dot, nothing of a forward before it."""
    t = f"translate({folded(d, column)}, '{LOOK_ALIKES[0]}', '{LOOK_ALIKES[1]}')"
    t = f"translate({t}, concat(chr(1), chr(2)), concat(chr(39), chr(34)))"
    t = d.replace(d.replace(t, HARMLESS, f"http{d.ref(1)}://"), BRACKETED, ".")
    t = d.replace(t, LAST_DOTS, d.ref(1) + d.ref(2))
    return d.replace(d.replace(t, BLANKS, " "), FORWARDING, "")


def _folding() -> tuple[str, str]:
    """Letters with marks, look-alike letters and capitals, and what ``readable`` makes of each alone."""
    capitals = "".join(map(chr, range(65, 91)))
    return MARKED + LOOK_ALIKES[0][:8] + capitals, PLAIN.lower() + LOOK_ALIKES[1][:8] + capitals.lower()


def wide(c: str) -> str:
    """Whether a text holds letters beyond ASCII."""
    return f"octet_length({c}) > length({c})"


def _when(condition: str, then: str, c: str) -> str:
    return f"CASE WHEN {condition} THEN {then} ELSE {c} END"


def _holding(c: str, parts: tuple[str, ...], then: str) -> str:
    return _when(" OR ".join(f"contains({c}, {p})" for p in parts), then, c)


def _chained(c: str, chain) -> str:
    """Steps one upon another within an expression, each over the result of the one before."""
    values = f"array({c})"
    for step in chain:
        values = f"transform({values}, y -> {step('y')})"
    return f"get({values}, 0)"


def _letter(a: str, b: str):
    return lambda c: _holding(c, (f"'{a}'",), SPARK.swapped(c, a, b))


#: Spark's steps for ``readable``, each an expression over the text of the step before.  ``TIDYING`` undoes what is strewn over
#: a text: invisible letters, wide digits, marks, runs of blanks, quoting.  ``FOLDING`` reads what is left: other letters beyond
#: ASCII by one map, then what is still beyond it as any text, with the look-alikes among its capitals.  Each letter has the
#: same result in any order, no later step makes or parts blanks, and no pattern reaches into the signs of a quotation.
#: Letters and patterns are replaced only in texts that hold what any match must hold: most texts hold none of it.
_MARKS = [_letter(a, b) for a, b in zip(LOOK_ALIKES[0][8:], LOOK_ALIKES[1][8:].replace("\1", "'").replace("\2", '"'))]
_FROM, _TO = map(_spelled, _folding())
TIDYING = (
    lambda c: _when(wide(c), _chained(c, [lambda y: _when(SPARK.has(y, INVISIBLE), SPARK.replace(y, INVISIBLE, ""), y), *_MARKS]), c),
    lambda c: _holding(c, ("'  '", "chr(9)"), SPARK.replace(c, BLANKS, " ")), lambda c: _when(f"ascii({c}) IN (9, 10, 11, 12, 13, 32, 62)", SPARK.replace(c, r"^(?:\s*>+)+\s*", ""), c),
)
FOLDING = (
    lambda c: f"CASE WHEN {wide(c)} THEN translate({c}, {_FROM}, {_TO}) ELSE lower({c}) END", lambda c: _when(wide(c), f"lower({c})", c),
    lambda c: _when(f"{wide(c)} AND {SPARK.has(c, '[' + LOOK_ALIKES[0][:8] + ']')}", f"translate({c}, '{LOOK_ALIKES[0][:8]}', '{LOOK_ALIKES[1][:8]}')", c),
    lambda c: _holding(c, ("chr(1)", "chr(2)"), f"translate({c}, concat(chr(1), chr(2)), concat(chr(39), chr(34)))"), lambda c: _holding(c, ("'hxxp'",), SPARK.replace(c, HARMLESS, "http$1://")),
    lambda c: _holding(c, ("'[.]'", "'(.)'"), SPARK.replace(c, BRACKETED, ".")), lambda c: _holding(c, ("'://'",), SPARK.replace(c, LAST_DOTS, "$1$2")),
)


def unforwarded(c: str) -> str:
    return _when(f"ascii({c}) IN (9, 10, 11, 12, 13, 32, 45, 62, 98)", SPARK.replace(c, FORWARDING, ""), c)  # blanks, -, > and b


def _each(chain, column: str, into: str) -> list[list[str]]:
    names = [column, *(f"{into}_{i}" for i in range(1, len(chain))), into]
    return [[f"{step(before)} AS {after}"] for step, before, after in zip(chain, names, names[1:])]


def reading(column: str, into: str) -> list[list[str]]:
    """Spark's projections for ``readable``, the last one named ``into``; ``into``_tidy is the text between."""
    return [*_each(TIDYING, column, f"{into}_tidy"), *_each((*FOLDING, unforwarded), f"{into}_tidy", into)]


#: Signals over other signals, and signals over the text as it is written; all others are over the folded text.
LATE, WRITTEN = ("shortened", "abused"), ("spliced", "n_foreign_letters", "n_latin_letters")


#: Signals that no rule looks at unless another one holds, with what stands for them else.  Names in the conditions are ungated.
NEEDED = {
    **dict.fromkeys(("delivery",), ("fix_address", "FALSE")), **dict.fromkeys(("rental", "changed"), ("bank", "FALSE")), "deposit": ("keys_by_post", "FALSE"),
    **dict.fromkeys(("money_ask", "pretext"), ("family", "FALSE")), "redirect": ("settlement", "FALSE"), "protective": ("settlement OR call", "FALSE"),
    "n_claim": ("n_reward > 0", "0"), "n_claim_noun": ("n_reward > 0", "0"), "n_service": ("n_ask > 0", "0"), "amount": ("fee", "CAST(0 AS DOUBLE)"),
    "link_host": ("link", "''"), **dict.fromkeys(("plain_http", "glued"), ("link", "FALSE")), **dict.fromkeys(("unofficial_link", "no_link_sender"), ("link AND authority", "FALSE")),
    **dict.fromkeys(("run_dialog", "terminal"), ("paste", "FALSE")), "unlock": ("tasks", "FALSE"), "release_fee": ("recovered", "FALSE"), "crypto": ("n_investment > 0", "FALSE"),
    **dict.fromkeys(("chat_app", "add_us"), ("authority", "FALSE")), **dict.fromkeys(("billed", "disown", "call_us", "exchange", "phone"), ("call", "FALSE")),
    "n_latin_letters": ("spliced OR n_foreign_letters >= 30", "0"),
}


#: How the first word of each match of a signal begins: its first five letters, or the whole word if it has fewer.  For a
#: signal of a list of phrases see ``leads``.
LEADS = {
    "n_claim": "claim", "family": "hi hey hello", "fee": "fee charg posta levy", "fix_address": "updat confi corre", "bank": "bank accou bsb iban", "benefit": "eligi entit", "settlement": "settl trust conve",
    "reply_trick": "reply", "qr": "scan", "voicemail": "new liste", "paste": "paste", "unverified": "unver not", "tasks": "task tasks earni commi", "code_ask": "send give tell forwa read", "chat_status": "whats teleg",
    "winnings": "verif winni jackp", "recovered": "recov", "call": "call ring phone dial",
}
LISTED = {
    "n_urgency": "urgency", "n_reward": "reward", "n_ask": "ask", "coaching": "coaching", "keys_by_post": "keys_by_post", "n_jobs": "jobs", "n_investment": "investment", "authority": "authority",
    "outlandish": "foreign_authority", "brand": "brands", "misspelt": "misspelt", "platform": "platforms", "reregister": "reregistration",
}
#: Signals over the text without negated clauses whose words are looked for first.
IN_CLAUSES = ("n_ask", "bank", "code_ask")


def leads(region: str | None) -> dict[str, list[str]]:
    """Signal -> how a word of the text must begin for it to be found; signals that any text may show are left out."""
    p, out = lexicon.pack(region), {k: v.split() for k, v in LEADS.items()}
    for name, own in LISTED.items():
        starts = [re.match(r"\w{1,5}", v, re.ASCII) for v in p[own]]
        if all(starts):
            out[name] = sorted({m[0] for m in starts} | ({"re"} if name == "reregister" else set()))
    return out


def begins(starts: list[str]) -> str:
    return "(" + " OR ".join(f"array_contains(words, '{x}')" for x in starts) + ")" if starts else "FALSE"


def searched(found: dict[str, str], region: str | None) -> dict[str, str]:
    """Spark's signals, searched for only in texts with a word that begins as a match does, or with letters beyond ASCII."""
    none = lambda k: "0" if k.startswith("n_") else "FALSE"
    where = {k: begins(v) for k, v in leads(region).items()} | dict.fromkeys(("spliced", "n_foreign_letters"), wide("raw"))
    return {k: f"CASE WHEN {where[k]} THEN {v} ELSE {none(k)} END" if k in where else v for k, v in found.items()}


def word_starts(starts: list[str]) -> str:
    """A pattern for words that begin so, by first letters; what is shorter than five letters is the whole word."""
    by_letter: dict[str, list[str]] = {}
    for x in sorted(starts, key=lambda x: (-len(x), x)):
        by_letter.setdefault(x[0], []).append(x[1:] + (r"(?!\w)" if len(x) < 5 else ""))
    return r"\b" + lettered({a: f"{a}(?:{'|'.join(rest)})" for a, rest in by_letter.items()})


def wording(regions: tuple[str | None, ...], where: str = "TRUE", beside: bool = False) -> list[list[str]]:
    """Spark's projections to ``words``, the beginnings of words that some signal needs, and ``s``; for rows that are ``where``.
    ``beside``: of a text that is another one, ``t0``, and something behind a blank, only that is read, since no word is in
    both; the rest are ``words0``."""
    own = [leads(r) for r in regions]
    every = sorted({x for by_name in own for starts in by_name.values() for x in starts})
    clauses = sorted({x for by_name in own for n in IN_CLAUSES for x in by_name.get(n, ())})
    open_ = begins(clauses) if all(n in by_name for by_name in own for n in IN_CLAUSES) else "TRUE"
    words = [[f"CASE WHEN {where} THEN {SPARK.every('t', word_starts(every))} END AS words"]]
    if beside:
        words = [
            ["startswith(t, concat(t0, ' ')) AS longer"], [f"CASE WHEN {where} THEN CASE WHEN longer THEN substring(t, length(t0) + 1) ELSE t END ELSE '' END AS unread"],
            [f"{SPARK.every('unread', word_starts(every))} AS unread_words"], ["CASE WHEN longer THEN concat(words0, unread_words) ELSE unread_words END AS words"],
        ]
    return [*words, [f"CASE WHEN {where} AND {open_} THEN {clean_clauses(SPARK)} ELSE '' END AS s"]]


def finding(found: dict[str, str]) -> list[dict[str, str]]:
    """Spark's projections that find signals, name -> expression: those that some rule always looks at, those that only
    count beside one of the first, and those over other signals."""
    gated = {k: f"CASE WHEN {NEEDED[k][0]} THEN ({v}) ELSE {NEEDED[k][1]} END" for k, v in found.items() if k in NEEDED}
    return [{k: f"({v})" for k, v in found.items() if k not in (*gated, *LATE)}, gated, {k: f"({found[k]})" for k in LATE}]


def _listed(found: dict[str, str]) -> list[str]:
    return [f"{v} AS {k}" for k, v in found.items()]


def clean_clauses(d: Spark) -> str:
    """The folded text without its negated clauses."""
    clauses = d.pieces(d.replace("t", NEW_REQUEST, ". " + d.ref(1)), CLAUSE_END)
    return d.join(d.kept(clauses, "c", f"NOT {d.has('c', NEGATED)}"), ". ")


def steps(d: Spark, region: str | None, channel: str = "sms") -> list[list[str]]:
    """The projections, each a list of "expression AS name" beside all columns before: raw to evidence."""
    every = signals(d, region)
    found = {k: v for k, v in every.items() if k not in LATE}
    first = [f"{readable(d, 'raw')} AS t"]
    second = [f"{clean_clauses(d)} AS s"]
    third = [f"({v}) AS {k}" for k, v in found.items()]
    fourth = [f"({every[k]}) AS {k}" for k in LATE]
    tier = lexicon.pack(region)["tier"]
    weights = weighing(d, rules(region, channel), "TRUE" if tier == "full" else "FALSE")
    weights[-1].append(f"'{tier}' AS coverage")
    if type(d) is Spark:  # computed where they are needed; SQL leaves that to its own optimizer
        return [*reading("raw", "t"), *wording((region,)), *map(_listed, finding(searched(every, region))), *weights]
    return [first, second, third, fourth, *weights]


def weighing(d: Spark, own: list[MessageRule], full_cover: str) -> list[list[str]]:
    """The projections from signals to score, evidence, pending and verdict."""
    fifth = [f"{d.whole(f'CASE WHEN {r.condition} THEN {r.points} ELSE 0 END')} AS p_{r.rule_id}" for r in own if not r.deferred]
    fifth += [f"({r.condition}) AS w_{r.rule_id}" for r in own if r.deferred]
    base = " + ".join(f"p_{r.rule_id}" for r in own if not r.deferred)
    full = " + ".join(f"p_{r.rule_id}" for r in own if r.full)
    sixth = [f"{d.once(d.whole(base))} AS base", f"{d.once(d.whole(full))} AS full_points"]
    seventh = [f"{d.whole(f'CASE WHEN w_{r.rule_id} AND base > 0 THEN {r.deferred} ELSE 0 END')} AS p_{r.rule_id}" for r in own if r.deferred]
    every = " + ".join(f"p_{r.rule_id}" for r in own)
    listed = ", ".join(f"CASE WHEN p_{r.rule_id} > 0 THEN concat('{r.rule_id}:', CAST(p_{r.rule_id} AS STRING)) END" if isinstance(d, Spark) and type(d) is Spark else f"CASE WHEN p_{r.rule_id} > 0 THEN '{r.rule_id}:' || p_{r.rule_id} END" for r in own)
    pending = " OR ".join(f"w_{r.rule_id}" for r in own if r.deferred)
    total, told, waits = d.whole(f"least({every}, 100)"), f"concat_ws(',', {listed})", f"base = 0 AND ({pending})"
    eighth = [f"{d.once(total)} AS score", f"{d.once(told)} AS evidence", f"{d.once(waits)} AS pending"]
    verdict = "CASE WHEN score >= 45 THEN 'likely_scam' WHEN score >= 20 THEN 'suspicious' ELSE 'safe' END"
    reads = f"{full_cover} AND NOT (n_foreign_letters >= 30 AND n_foreign_letters > n_latin_letters)"
    ninth = [f"CASE WHEN score < 20 AND NOT ({reads}) THEN 'unknown' ELSE {verdict} END AS verdict"]
    return [fifth, sixth, seventh, eighth, ninth]


RESULT = ["score", "base", "full_points", "pending", "evidence", "verdict", "coverage"]


def scored(df: DataFrame, text: str = "text", region: str | None = None, channel: str = "sms") -> DataFrame:
    """The input's rows with score, base (before deferred rules), full_points, pending, evidence, verdict and coverage."""
    # The row travels in a struct, so that its columns may have any name.
    out = df.select(F.struct("*").alias("own_row"), F.coalesce(F.col(text), F.lit("")).alias("raw"))
    for step in steps(SPARK, region, channel):
        out = out.selectExpr("*", *step)
    return out.select(*(F.col("own_row").getField(c).alias(c) for c in df.columns if c not in RESULT), *RESULT)


def _stepped(df: DataFrame, some_steps: list[list[str]]) -> DataFrame:
    for step in some_steps:
        df = df.selectExpr("*", *step)
    return df


def scored_by_region(df: DataFrame, regions: tuple[str, ...], text: str = "text", channel: str = "sms") -> DataFrame:
    """The input's rows once for each region, as ``scored`` gives them, and ``region``.

    A text is read once: signals of the same words in all regions are found once, the others once for
    each list of words, and only weighing, which is arithmetic on them, is done for each region.
    """
    found = {r: searched(signals(SPARK, r), r) for r in regions}
    own = {n: list(dict.fromkeys(found[r][n] for r in regions)) for n in found[regions[0]]}
    column = {r: {n: f"{n}_{kinds.index(found[r][n])}" for n, kinds in own.items() if len(kinds) > 1} for r in regions}
    plain = lambda r, condition: re.sub("[a-z_]+", lambda m: column[r].get(m[0], m[0]), condition)
    layers: list[dict[str, str]] = [{}, {}, {}]
    for name, kinds in own.items():
        for i, kind in enumerate(kinds):
            layer, into = (2 if name in LATE else 1 if name in NEEDED else 0), name if len(kinds) == 1 else f"{name}_{i}"
            if layer == 1:  # needed where any of the regions with these words needs it
                wanted = " OR ".join(dict.fromkeys(f"({plain(r, NEEDED[name][0])})" for r in regions if found[r][name] == kind))
                kind = f"CASE WHEN {wanted} THEN ({kind}) ELSE {NEEDED[name][1]} END"
            layers[layer][into] = f"({kind})"
    shared = [n for n, kinds in own.items() if len(kinds) == 1]
    out = df.select(F.struct("*").alias("own_row"), F.coalesce(F.col(text), F.lit("")).alias("raw"))
    out = _stepped(out, [*reading("raw", "t"), *wording(regions), *map(_listed, layers)])

    def told(r: str) -> str:
        flags, tier = lexicon.pack(r)["flags"], lexicon.pack(r)["tier"]
        parts = [("region", f"'{r}'"), ("coverage", f"'{tier}'"), *((f"on_{f}", "TRUE" if f in flags else "FALSE") for f in SWITCHES), *column[r].items()]
        return "struct(" + ", ".join(f"{v} AS {k}" for k, v in parts) + ")"

    each = "explode(array(" + ", ".join(map(told, regions)) + ")) AS each"
    fields = ["region", "coverage", *(f"on_{f}" for f in SWITCHES), *column[regions[0]]]
    out = out.selectExpr("own_row", *shared, each).selectExpr("own_row", *shared, *(f"each.{f} AS {f}" for f in fields))
    out = _stepped(out, weighing(SPARK, rules(regions[0], channel, by_row=True), "coverage = 'full'"))
    return out.select(*(F.col("own_row").getField(c).alias(c) for c in df.columns if c not in (*RESULT, "region")), "region", *RESULT)


def rewritten(df: DataFrame, ways: dict[str, tuple[bool, str]], keys: tuple[str, ...], region: str | None = None, channel: str = "sms", differing: bool = False) -> DataFrame:
    """The rows' keys once for each way (name -> flag, expression over ``text``) to rewrite their text:
    relation, equal_to (the flag), before, text, was and score.

    Most ways leave the folded text as it was, others lead to the same one, and signals are functions of it but for
    those of the text as it is written.  So a row's texts are read as an array, and signals are taken from the row's own
    text or searched for once for each other folded text.
    ``differing``: only rows whose signals may differ from those of the row's own text; all others keep its score.
    """
    own, tier = searched(signals(SPARK, region), region), lexicon.pack(region)["tier"]
    weights = weighing(SPARK, rules(region, channel), "TRUE" if tier == "full" else "FALSE")[:-1]  # verdicts are not asked for
    layers = finding(own)
    # Arrays are computed where they stand: a lambda or a filter would compute them again for each element.
    kept = lambda array, name: [f"{SPARK.once(array)} AS {name}"]
    out = df.select(*keys, F.col("text").alias("before"), F.coalesce(F.col("text"), F.lit("")).alias("raw0"), F.col("text"))
    out = out.selectExpr(*keys, "before", "raw0", *kept("array(" + ", ".join(x for _, x in ways.values()) + ")", "texts"))
    # A text that is tidy as the row's own reads as that does; of one with more words behind only these are read, unless a
    # forward's head may go on in them.
    behind = "CASE WHEN ascii(t0) NOT IN (0, 45, 62, 98) THEN concat(t0_tidy, ' ') END AS t0_behind"
    out = _stepped(out, [*reading("raw0", "t0"), [behind]]).selectExpr(*keys, "before", "raw0", "t0", "t0_tidy", "t0_behind", "texts")
    all_texts = lambda chain, column, into: _each([lambda c, step=step: f"transform({c}, x -> {step('x')})" for step in chain], column, into)
    out = _stepped(out, all_texts((lambda x: f"CASE WHEN {x} = raw0 THEN '' ELSE coalesce({x}, '') END", *TIDYING), "texts", "tidy_texts"))
    out = out.selectExpr(*keys, "before", "raw0", "t0", "t0_tidy", "t0_behind", "texts", *kept("tidy_texts", "tidy"))
    more = lambda x: f"CASE WHEN {x} = t0_tidy THEN '' WHEN startswith({x}, t0_behind) THEN substring({x}, length(t0_tidy) + 1) ELSE {x} END"
    out = _stepped(out, all_texts((more, *FOLDING), "tidy", "read_texts"))
    out = out.selectExpr(*keys, "before", "raw0", "t0", "t0_tidy", "t0_behind", "texts", "tidy", *kept("read_texts", "read"))
    folded_text = f"CASE WHEN x = raw0 OR tidy[i] = t0_tidy THEN t0 WHEN startswith(tidy[i], t0_behind) THEN concat(t0, read[i]) ELSE {unforwarded('read[i]')} END"
    out = out.selectExpr(*keys, "before", "raw0", "t0", *kept(f"transform(texts, (x, i) -> struct(i AS way, x AS text, {folded_text} AS t))", "every_way"))
    if differing:
        # Without letters beyond ASCII in either text, no signal of the text as it is written is found in them.
        other = f"coalesce(w.text, '') <> raw0 AND (w.t <> t0 OR {wide('w.text')} OR {wide('raw0')})"
        out = out.selectExpr(*keys, "before", "raw0", "t0", *kept(f"filter(every_way, w -> {other})", "every_way"))
    out = out.selectExpr(*keys, "before", "raw0", "t0", *kept("transform(array_distinct(every_way.t), u -> struct(u AS t, filter(every_way, w -> w.t = u) AS alike))", "by_text"))
    out = _stepped(out.selectExpr("*", "t0 AS t", "raw0 AS raw"), [*wording((region,)), *map(_listed, layers)])
    first = [*keys, "before", "raw0", "t0", "words0", "found", "was"]
    out = _stepped(out.selectExpr(*keys, "before", "raw0", "t0", "words AS words0", "by_text", *own, "struct(" + ", ".join(own) + ") AS found"), weights)
    out = out.selectExpr(*keys, "before", "raw0", "t0", "words0", "found", "score AS was", "explode(by_text) AS each").selectExpr(*first, "each.t AS t", "each.alike AS alike")
    in_t = lambda k, v: f"CASE WHEN t = t0 THEN found.{k} ELSE {v} END"
    written = lambda k, v: f"CASE WHEN raw = raw0 THEN found.{k} ELSE {v} END"
    out = _stepped(out, wording((region,), "t <> t0", beside=True))
    out = _stepped(out, [_listed({k: in_t(k, v) for k, v in layer.items() if k not in WRITTEN}) for layer in layers])
    read_once = [k for k in own if k not in WRITTEN]
    out = out.selectExpr(*keys, "before", "raw0", "found", "was", *read_once, "explode(alike) AS each")
    names, flags = SPARK.array(ways), "array(" + ", ".join(str(same).upper() for same, _ in ways.values()) + ")"
    told = [*keys, "before", "found", "was", SPARK.at(names, "each.way") + " AS relation", SPARK.at(flags, "each.way") + " AS equal_to", "each.text AS text"]
    out = out.selectExpr(*told, "raw0", "coalesce(each.text, '') AS raw", *read_once)
    out = _stepped(out, [_listed({k: written(k, layer[k]) for k in layer if k in WRITTEN}) for layer in layers if set(layer) & set(WRITTEN)])
    out = _stepped(out.selectExpr(*keys, "before", "was", "relation", "equal_to", "text", *own), weights)
    return out.select(*keys, "relation", "equal_to", "before", "text", "was", "score")


def scored_sql(d: Spark, source: str, text: str = "text", region: str | None = None, channel: str = "sms", name: str = "scored") -> str:
    """The same as nested SQL: a WITH part that ends in a table ``name``."""
    parts, last = [f"{name}_0 AS (SELECT *, coalesce({text}, '') AS raw FROM {source})"], f"{name}_0"
    all_steps = steps(d, region, channel)
    for i, step in enumerate(all_steps, 1):
        now = name if i == len(all_steps) else f"{name}_{i}"
        parts.append(f"{now} AS (SELECT *, {', '.join(step)} FROM {last})")
        last = now
    return ", ".join(parts)


def rule_rows(region: str | None) -> list[tuple[str, str, int, bool]]:
    """rule_id, points as written, deferred points, full: the inventory of a region's rules."""
    return sorted((r.rule_id, r.points, r.deferred, r.full) for r in rules(region))
