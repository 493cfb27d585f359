"""Personal data by regular expressions, checksum validators and context words, in DataFrame functions only.

Each kind's pattern proposes spans, a validator confirms them, and words within ``CONTEXT_CHARS`` characters of a span move its score from the kind's
own: the kind's context words raise it, words such as "example" lower it. Spans of the base kinds stay whatever their score; spans of
the further kinds, secrets among them, stay from ``MIN_SCORE`` on, so that digits that could be anything count only where
the words about them say so; a span of theirs that lies inside another's counts once, as the longer one, or the earlier kind of two over the same
span. Positions are code points, ends exclusive.

The patterns find what the plain ones do (leftmost, non-overlapping), but never re-scan a run of characters: starts inside a run are
barred by look-behinds, loops are possessive or bounded, and digit runs are counted inside the pattern. Time is linear in the text, and long
runs do not deepen the matcher's stack.

Edge cases: null text is empty; a text without spans has zero counts and empty lists; a null doc_id and repeated rows
come out as they came in; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SCORE = 0.5
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.3


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A cheap condition that every text with a match meets: a pattern, or strings of which the text holds one.
    gate: str | tuple[str, ...]
    score: float
    context: str
    #: Whether the gate is for the text in lower case, and whether a match holds MANY digits.
    lowered: bool = False
    digits: bool = False

#: What every match of the kinds of many digits holds; looked for once for all of them.
MANY = "[0-9](?:[ -]?[0-9]){3}"


#: The base patterns, with look-behinds and possessive loops added.
EMAIL = "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
CARD = "(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"
PHONE = "\\+[0-9][ ().0-9-]+[0-9]"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"

BASE = (
    Kind("email", EMAIL, ("@",), 0.9, "mail|e-mail|contact|write"),
    Kind("ip", IP, "[0-9]\\.[0-9]++\\.[0-9]++\\.[0-9]", 0.6, "ip|host|server|address"),
    Kind("card", CARD, "[0-9](?:[ -]?[0-9]){12}", 0.8, "card|visa|credit|debit|payment", digits=True),
    Kind("phone", PHONE, ("+",), 0.7, "phone|tel|call|mobile|fax"),
)
#: Countries by the length of their IBANs. A run of capitals and digits over blanks is cut at its country's length, so that words after it don't count.
IBAN_COUNTRIES = {
    15: "NO",
    16: "BE",
    18: "DK FI FO GL NL FK SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU XK MN",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM TL SO",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY PT ST MZ",
    26: "IR IS TR DZ",
    27: "BF BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC NI",
    33: "RU",
}
IBAN = "\\b(?:" + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}+(?![A-Za-z0-9])" for n, c in IBAN_COUNTRIES.items()) + ")"

_HEX, _SECRET_NAME = "(?<![A-Za-z0-9])[0-9a-f]{32}(?:[0-9a-f]{8})?(?![A-Za-z0-9])", "(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|secret[_-]?key|auth[_-]?token|client[_-]?secret)"

_GROUP = "[0-9A-Fa-f]{1,4}"
#: Eight groups, or fewer about a double colon; bounded, as a run of groups may be long.
_IPV6 = f"(?<![0-9A-Za-z:.])(?:{_GROUP}(?::{_GROUP}){{7}}+|(?:{_GROUP}(?::{_GROUP}){{0,6}}+)?+::(?:{_GROUP}(?::{_GROUP}){{0,6}}+)?+)(?![0-9A-Za-z:])"

FURTHER = (
    Kind("iban", IBAN, "\\b[A-Z]{2}[0-9]{2}", 0.8, "iban|account|bank"),
    Kind("mac", "(?<![0-9A-Fa-f:])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:])", (":",), 0.6, "mac|device|address"),
    Kind("ssn", "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", ("-",), 0.3, "ssn|social|security", digits=True),
    Kind("birth", "(?<![0-9-])(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9](?![0-9-])", ("-",), 0.25, "born|birth|birthday|dob", digits=True),
    Kind("passport", "(?<![A-Za-z0-9])[A-Z]{1,2}[0-9]{6,8}(?![A-Za-z0-9])", "[A-Z][0-9]{6}", 0.25, "passport|passeport|reisepass|pasaporte", digits=True),
    Kind("account", "(?<![0-9.-])[0-9]{8,12}(?![0-9.-])", "[0-9]{8}", 0.2, "account|konto|compte|cuenta", digits=True),
    Kind("aws_key", "(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])", ("AKIA", "ASIA"), 0.9, "aws|key|access"),
    Kind("assigned_secret", "(?i)(?<![A-Za-z])" + _SECRET_NAME + "(?:[\"']?[ ]?[:=]|[ ](?:is|was):?)[ ]?[\"']?[A-Za-z0-9+/_.~!@#$%^&*-]{8,}+", ("passw", "pwd", "passphrase", "secret", "token", "key"), 0.8, "login|credential|credentials|config", lowered=True),
    Kind("hex_secret", _HEX, "[0-9a-f]{32}", 0.3, "token|secret|key|password|hash"),
    Kind(
        "service_token",
        "(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,}+|glpat-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_-]{20,}+|AIza[A-Za-z0-9_-]{35}|hf_[A-Za-z0-9]{30,}+)",
        ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "sk_live_", "sk-", "AIza", "hf_"),
        0.9,
        "token|key",
    ),
    Kind("jwt", "(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\\.eyJ[A-Za-z0-9_-]{8,}+\\.[A-Za-z0-9_-]{8,}+", ("eyJ",), 0.9, "token|bearer|jwt"),
    Kind("ipv6", _IPV6, "::|(?::[0-9A-Fa-f]{1,4}){4}", 0.6, "ip|ipv6|host|server|address"),
    Kind("local_phone", "(?<![0-9A-Za-z+().-])(?:\\([0-9]{3}\\)[ ]?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9A-Za-z-])", "[0-9]{3}[-. ][0-9]{4}", 0.3, "phone|tel|telephone|call|mobile|cell|fax"),
    Kind("private_key", "-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", ("PRIVATE KEY",), 1.0, "key"),
)
#: Words that make a span an illustration rather than data, and what they take from its score.
ILLUSTRATION, ILLUSTRATION_MALUS = "example|sample|dummy|placeholder|beispiel|exemple|ejemplo", 0.3


def _luhn(match: Column) -> Column:
    digits = F.reverse(F.regexp_replace(match, "[ -]", ""))
    total = F.aggregate(
        F.transform(
            F.split(digits, ""),
            lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)),
        ),
        F.lit(0),
        lambda acc, x: acc + x,
    )
    return F.length(digits).between(13, 19) & (total % 10 == 0)


def _mod97(match: Column) -> Column:
    plain = F.replace(match, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    rest = F.aggregate(
        F.split(moved, ""),
        F.lit(0),
        lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97),
    )
    return F.length(plain).between(15, 34) & (rest == 1)


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(f"^{OCTET}(?:\\.{OCTET}){{3}}$")
    if kind == "card":
        return _luhn(match)
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(9, 15)
    if kind == "iban":
        return _mod97(match)
    if kind == "birth":
        return F.try_to_date(match).isNotNull()
    if kind == "ipv6":  # at most eight groups, and not the double colon of a program
        groups = F.size(F.filter(F.split(match, ":"), lambda g: g != ""))
        return groups.between(2, 8) & (~F.contains(match, F.lit("::")) | (groups < 8)) & match.rlike("[0-9]")
    if kind == "local_phone":
        return ~match.rlike("^\\(?[01]")
    if kind == "assigned_secret":  # a value that mixes letters and digits, not a word
        value = F.regexp_extract(match, "[A-Za-z0-9+/_.~!@#$%^&*-]++$", 0)
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    if kind == "hex_secret":
        return match.rlike("[a-f]") & match.rlike("[0-9]")
    return F.lit(True)


_SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


_MATCH = "array<struct<start:int,match:string,near:string>>"


#: Control characters that mark the two ends of a match; a text's own are other ones to the patterns, none of which matches any.
_OPEN, _CLOSE, _OTHER = "\x01", "\x02", "\x03"


def marked(text: Column) -> Column:
    """text without the characters that mark matches, as long as before."""
    return F.translate(text, _OPEN + _CLOSE, _OTHER + _OTHER)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, match, near>> of a pattern's matches: code points from 0, and the characters about each, as far as the matches beside it.

    text has no marks of its own. The pattern puts marks about its matches in one pass; plain searches then tell them from what stands between.
    """
    acc = F.struct(F.lit(0).alias("at"), F.array().cast(_MATCH).alias("out"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["before"])
        near = F.concat(F.substring(x["before"], -CONTEXT_CHARS, CONTEXT_CHARS), F.lit(" "), F.substring(x["after"], 1, CONTEXT_CHARS))
        return F.struct((start + F.length(x["match"])).alias("at"), F.array_append(a["out"], F.struct(start.alias("start"), x["match"].alias("match"), near.alias("near"))).alias("out"))

    def located(parts: Column) -> Column:
        between = F.filter(parts, lambda _, i: i % 2 == 0)
        found = F.filter(parts, lambda _, i: i % 2 == 1)
        n = F.size(found)
        zipped = F.arrays_zip(F.slice(between, F.lit(1), n).alias("before"), found.alias("match"), F.slice(between, F.lit(2), n).alias("after"))
        return F.when(n > 0, F.aggregate(zipped, acc, step, lambda a: a["out"])).otherwise(F.array().cast(_MATCH))

    return _let(F.split(F.regexp_replace(text, pattern, f"{_OPEN}$0{_CLOSE}"), f"[{_OPEN}{_CLOSE}]", -1), located)


def _let(value: Column, body) -> Column:
    """body of value, which is evaluated once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _kind_spans(text: Column, kind: Kind, required: bool) -> Column:
    def span(m: Column) -> Column:
        end = m["start"] + F.length(m["match"])
        bonus = F.when(m["near"].rlike(f"(?i)\\b(?:{kind.context})\\b"), CONTEXT_BONUS).otherwise(0.0)
        malus = F.when(m["near"].rlike(f"(?i)\\b(?:{ILLUSTRATION})\\b"), ILLUSTRATION_MALUS).otherwise(0.0)
        score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(kind.score) + bonus - malus)), 2)
        return F.struct(F.lit(kind.name).alias("kind"), m["start"].alias("start"), end.alias("end"), score.alias("score"))

    found = F.transform(F.filter(matches(text, kind.pattern), lambda m: _valid(kind.name, m["match"])), span)
    if not required:
        found = F.filter(found, lambda s: s["score"] >= MIN_SCORE)
    return F.when(_gated(kind) & text.rlike(kind.pattern), found.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def _gated(kind: Kind) -> Column:
    """Whether a text, t, may hold a match: plain searches and cheap patterns, each only if those before it hold."""
    text = F.col("low" if kind.lowered else "t")
    if isinstance(kind.gate, str):
        found = text.rlike(kind.gate)
    else:
        found = F.contains(text, F.lit(kind.gate[0]))
        for g in kind.gate[1:]:
            found = found | F.contains(text, F.lit(g))
    return F.col("many") & found if kind.digits else found


def _outermost(spans: Column, names: list[str]) -> Column:
    """spans without those that lie inside another, by kind in the order of names, then start."""
    rank = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    fields = ("kind", "start", "end", "score")
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), rank[s["kind"]].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), s["score"].alias("score"))))
    acc = F.struct(F.lit(-1).alias("reach"), F.array().cast("array<struct<rank:int,start:int,kind:string,end:int,score:double>>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        kept = F.struct(*[s[k].alias(k) for k in ("rank", "start", "kind", "end", "score")])
        return F.when(s["end"] > a["reach"], F.struct(s["end"].alias("reach"), F.array_append(a["out"], kept).alias("out"))).otherwise(a)

    ordered = F.array_sort(F.aggregate(keyed, acc, step, lambda a: a["out"]))
    return F.when(F.size(spans) < 2, spans).otherwise(F.transform(ordered, lambda s: F.struct(*[s[k].alias(k) for k in fields])))


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, email, ip, card, phone, further): arrays of spans (kind, start, end, score) for each row of docs."""
    text = F.col("t")
    rows = docs.select("doc_id", marked(F.coalesce("text", F.lit(""))).alias("t")).withColumns({"low": F.lower(text), "many": text.rlike(MANY)})
    base = [_kind_spans(text, k, True).alias(k.name) for k in BASE]
    rows = rows.select("doc_id", *base, F.concat(*[_kind_spans(text, k, False) for k in FURTHER]).alias("further"))
    return rows.withColumn("further", _outermost(F.col("further"), [k.name for k in FURTHER]))


def _joined(spans: Column, *fields: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", *[s[f].cast("string") for f in ("kind", "start", "end", *fields)])), ",")


def op9_pii_spans(docs: DataFrame) -> DataFrame:
    """The counts and digest of the base kinds, all spans, the same with their scores, the highest of these, and the number of secrets."""
    names = [k.name for k in BASE]
    secrets = ("aws_key", "assigned_secret", "hex_secret", "service_token", "jwt", "private_key")
    found = personal_data(docs).withColumn("base", F.concat(*names))
    found = found.withColumn("all", F.concat("base", "further"))
    return found.select(
        "doc_id",
        *[F.size(n).cast("long").alias(f"n_{n}") for n in names],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("all")).alias("spans"),
        _joined(F.col("all"), "score").alias("scored_spans"),
        F.coalesce(F.array_max(F.transform("all", lambda s: s["score"])), F.lit(0.0)).alias("score"),
        F.size(F.filter("further", lambda s: s["kind"].isin(*secrets))).cast("long").alias("n_secret"),
    )
