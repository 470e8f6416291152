"""Secrets and personal data out of text in one pass of one pattern.

All active rules form one alternation: at each place the first rule that matches wins, and what is put in is not
scanned again. The text is cut at its matches, each match is replaced by its rule, and the pieces are joined, all with
column functions.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import SEPARATOR, json_plain, json_string, let, strip

# Names of secrets and the shape of each rule, in order of precedence.
SECRET_NAMES = [
    "password", "passwd", "pwd", "secret", "api[_-]?key", "apikey", "access[_-]?token", "refresh[_-]?token", "auth[_-]?token", "id[_-]?token",
    "session[_-]?secret", "client[_-]?secret", "private[_-]?key", "authorization", "token",
]
RULES = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----",
    "jwt": r"\beyJ[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{4,}\b",
    "aws_key": r"\b(?:AKIA|ASIA|AGPA|AIDA|AROA|ANPA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{20,}\b",
    "slack_token": r"\bxox[abprs]-[A-Za-z0-9-]{10,}\b",
    "stripe_key": r"\b[sr]k_(?:live|test)_[A-Za-z0-9]{10,}\b",
    "url_credentials": r"\b[a-zA-Z][\w+.-]*://[^\s/:@]+:[^\s/@]+@",
    "secret_kv": rf"""(?i:\b(?:{"|".join(SECRET_NAMES)})\s*[=:]\s*(?:Bearer\s+|Basic\s+|Token\s+)?(?:"[^"]*"|'[^']*'|[^\s,;&)}}\]]+))""",
    "bearer": r"\b[Bb](?:earer|asic)\s+(?!\[REDACTED)[A-Za-z0-9._~+/=-]{12,}",
    "email": r"\b[\w.%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "card": r"\b(?:\d[ -]?){12,18}\d\b",
    "ip": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
}
#: In strict mode a quote may stand between a key and its separator, as in JSON.
STRICT_KV = RULES["secret_kv"].replace(r")\s*[=:]\s*(?:Bearer", r""")["']?\s*[=:]\s*(?:Bearer""")
#: What every match of a rule holds; cheap to look for.
ANCHORS = {
    "private_key": "-----BEGIN",
    "jwt": "eyJ[A-Za-z0-9_-]{6}",
    "aws_key": "A(?:KIA|SIA|GPA|IDA|ROA|NPA)[0-9A-Z]",
    "github_token": "gh[pousr]_",
    "slack_token": "xox[abprs]-",
    "stripe_key": "[sr]k_(?:live|test)_",
    "url_credentials": r"://[^\s/:@]+:",
    "secret_kv": r"""(?i:[dtyn](?<=word|swd|pwd|cret|key|oken|tion)["']?\s*[=:])""",  # the ends of SECRET_NAMES
    "bearer": r"[Bb](?:earer|asic)\s",
    "email": r"@[A-Za-z0-9.-]",
    "card": r"\d(?:[ -]?\d){12}",
    "ip": r"\d\.\d{1,3}\.",
}
#: What no match of any rule is without, in a text or in the JSON text of it: a mark, an escape, or thirteen characters.
WORTH = r"(?s)[-._:=@\\]|^.{13}"
SECRET_KEY = rf'(?i)^(?:.*[._-])?(?:{"|".join(SECRET_NAMES)})$'


@dataclass(frozen=True)
class Policy:
    enabled: bool = True
    redact_ips: bool = False
    redact_cards: bool = True
    disabled: frozenset[str] = field(default_factory=frozenset)
    strict: bool = False

    def active(self) -> list[str]:
        """Rule names in order; a disabled rule stays off whatever else asks for it."""
        switches = {"ip": self.redact_ips, "card": self.redact_cards}
        return [rule for rule in RULES if self.enabled and switches.get(rule, True) and rule not in self.disabled]

    @classmethod
    def of_json(cls, text: str | None) -> Policy:
        """The policy that a sidecar states; the default one where it is absent or wrong."""
        try:
            stated = json.loads(text or "{}")
            flags = {f: stated[f] for f in ("enabled", "redact_ips", "redact_cards") if f in stated}
            off = stated.get("disabled", [])
            if not all(isinstance(v, bool) for v in flags.values()) or not all(isinstance(r, str) for r in off):
                return cls()
            return cls(**flags, disabled=frozenset(off))
        except (ValueError, TypeError, AttributeError):
            return cls()

    def prefilter(self) -> str:
        """No active rule matches a text in which this finds nothing."""
        return "(?U)" + "|".join(ANCHORS[rule] for rule in self.active())

    def pattern(self, rule: str) -> str:
        return STRICT_KV if rule == "secret_kv" and self.strict else RULES[rule]


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    each = F.filter(F.split(F.reverse(digits), ""), lambda d: d != "")
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def rule_of(match: Column, policy: Policy) -> Column:
    """The rule that made a match; null for a card that fails its check."""
    valid_card = let(F.regexp_replace(match, "[ -]", ""), lambda d: F.rlike(d, F.lit(r"^\d{13,19}$")) & luhn(d))
    out = F.lit(None).cast("string")
    for rule in reversed(policy.active()):
        name = F.when(valid_card, F.lit(rule)) if rule == "card" else F.lit(rule)
        out = F.when(F.rlike(match, F.lit(rf"(?U)^(?:{policy.pattern(rule)})$")), name).otherwise(out)
    return out


def replacement(match: Column, rule: Column) -> Column:
    return (
        F.when(rule.isNull(), match)
        .when(rule == "url_credentials", F.concat(F.regexp_extract(match, r"(?s)^(.*?://)", 1), F.lit("[REDACTED]@")))
        .when(rule == "secret_kv", F.concat(F.regexp_extract(match, r"(?s)^([^=:]*[=:]\s*)", 1), F.lit("[REDACTED]")))
        .when(rule == "bearer", F.concat(F.left(match, F.regexp_instr(match, F.lit(r"\s")) - 1), F.lit(" [REDACTED]")))
        .otherwise(F.concat(F.lit("[REDACTED:"), rule, F.lit("]")))
    )


def redacted(text: Column, policy: Policy) -> Column:
    """(text, rules): the text after all rules, and the rule of each replacement in order.

    ``text`` is mentioned several times; texts without an anchor of an active rule are looked at once.
    """
    none = F.array().cast("array<string>")
    active = policy.active()
    if not active:
        return F.struct(text.alias("text"), none.alias("rules"))
    pattern = "(?U)" + "|".join(f"(?:{policy.pattern(r)})" for r in active)

    def judged(m: Column) -> Column:
        return let(F.struct(m.alias("m"), rule_of(m, policy).alias("rule")), lambda x: F.struct(replacement(x["m"], x["rule"]).alias("put"), x["rule"].alias("rule")))

    def joined(pieces: Column) -> Column:
        return F.struct(F.array_join(F.transform(pieces, lambda x: x["put"]), "").alias("text"), F.filter(F.transform(pieces, lambda x: x["rule"]), lambda r: r.isNotNull()).alias("rules"))

    # One scan sets marks around the matches; texts that hold the mark are scanned for matches and gaps apart.
    between = lambda x: F.struct(x.alias("put"), F.lit(None).cast("string").alias("rule"))
    marked = F.split(F.regexp_replace(text, F.lit(f"({pattern})"), F.lit(f"{SEPARATOR}$1{SEPARATOR}")), SEPARATOR, -1)
    apart = F.flatten(F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.array(g, F.coalesce(m, F.lit("")))))
    pieces = F.transform(F.when(F.contains(text, F.lit(SEPARATOR)), apart).otherwise(marked), lambda x, i: F.when((i % 2 == 0) | (x == ""), between(x)).otherwise(judged(x)))
    near = F.rlike(text, F.lit(WORTH)) & F.rlike(text, F.lit(policy.prefilter()))
    return F.when(near, let(pieces, joined)).otherwise(F.struct(text.alias("text"), none.alias("rules")))


def secret_name(key: Column) -> Column:
    return F.rlike(key, F.lit("(?i)[dtyn]$")) & F.rlike(key, F.lit(SECRET_KEY))  # names are mostly told apart by their last letter


#: Blanks of JSON.
_B = r"[ \t\r\n]*+"
#: A token of JSON text with the blanks around it: a way down, which is a run of opening brackets, commas and plain keys that
#: are no secret names; a run of closing brackets; a string; what is left. Possessive, so its length is no matter.
TOKEN = (
    rf"""(?s){_B}(?:(?:[{{\[,]{_B}|(?!(?i:"(?:[\w.-]*[._-])?(?:{"|".join(SECRET_NAMES)})"))"[\w.-]*+"{_B}:{_B})++|[}}\]]++|"""
    rf"""(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|:|[^"{{}}\[\]:, \t\r\n]++|.)){_B}"""
)
#: A key that ends in a secret name, in JSON text.
SECRET_FIELD = rf'(?i)["._-](?:{"|".join(SECRET_NAMES)})"[ \t\r\n]*+:'


def hidden(tokens: Column) -> Column:
    """(start, end, rest) of the values under secret names among the ``tokens`` of JSON text, at any depth.

    One pass over the tokens with a count of open brackets; a value that is taken out is not looked into. Nulls and
    empty strings, lists and objects stay. ``rest``: the brackets of the last token that close what is around the value.
    """
    at = lambda i: strip(F.get(tokens, i))
    span = "struct<start:int,end:int,rest:string>"
    start = F.struct(
        F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(-1).alias("since"), F.lit(0).alias("outside"), F.array().cast(f"array<{span}>").alias("spans")
    )
    closing = lambda t: t.startswith("}") | t.startswith("]")

    def step(a: Column, token: Column) -> Column:
        def judged(t: Column) -> Column:
            string = t.startswith('"') & t.endswith('"')
            change = F.when(closing(t), -F.length(t)).when(string, 0).otherwise(F.length(t) - F.length(F.translate(t, "{[", "")))

            def moved(n: Column) -> Column:
                opens = n > 0
                named = (at(a.i - 1) == ":") & F.coalesce(F.rlike(at(a.i - 2), F.lit(rf'(?is)^"(?:.*[._-])?(?:{"|".join(SECRET_NAMES)})"$')), F.lit(False))
                empty = t.isin("{", "[") & F.coalesce(closing(at(a.i + 1)), F.lit(False))
                value = (a.since < 0) & named & ~t.isin("null", '""') & ~empty
                done = (a.since >= 0) & (n < 0) & (a.depth + n <= a.outside)
                whole = F.struct(a.i.alias("start"), a.i.alias("end"), F.lit("").alias("rest"))
                taken = F.struct(a.since.alias("start"), a.i.alias("end"), F.substr(t, a.depth - a.outside + 1).alias("rest"))
                here = F.when(done, taken).when(value & ~opens, whole)
                return F.struct(
                    (a.i + 1).alias("i"),
                    (a.depth + n).alias("depth"),
                    F.when(done, -1).when(value & opens, a.i).otherwise(a.since).alias("since"),
                    F.when(value & opens, a.depth).otherwise(a.outside).alias("outside"),
                    F.when(here.isNotNull(), F.concat(a.spans, F.array(here))).otherwise(a.spans).alias("spans"),
                )

            return let(change, moved)

        return let(strip(token), judged)

    return F.aggregate(tokens, start, step, lambda a: a.spans)


def redacted_string(text: Column, policy: Policy) -> Column:
    """(text, rules) of the JSON text of a string; what it says is scanned, not how it is written."""
    return let(redacted(json_plain(text), policy), lambda r: F.struct(F.when(F.size(r["rules"]) > 0, json_string(r["text"])).otherwise(text).alias("text"), r["rules"].alias("rules")))


def redacted_nested(text: Column, policy: Policy) -> Column:
    """(text, rules) of the JSON text of an object or list: values under secret names, and strings at any depth."""
    none = F.array().cast("array<string>")
    by_name = "secret_kv" in policy.active()

    def walked(tokens: Column) -> Column:
        nothing = F.array().cast("array<struct<start:int,end:int,rest:string>>")
        spans = F.when(F.rlike(text, F.lit(SECRET_FIELD)), hidden(tokens)).otherwise(nothing) if by_name else nothing
        plain = lambda t: F.struct(t.alias("text"), none.alias("rules"))
        is_value = lambda t, i: t.startswith('"') & t.endswith('"') & (F.coalesce(strip(F.get(tokens, i + 1)), F.lit("")) != ":")
        each = F.transform(tokens, lambda t, i: let(strip(t), lambda s: F.when(is_value(s, i), redacted_string(s, policy)).otherwise(plain(t))))
        scanned = F.when(F.rlike(text, F.lit(policy.prefilter())), each).otherwise(F.transform(tokens, plain))

        def rejoined(x: Column) -> Column:
            last = F.struct(F.size(tokens).alias("start"), F.size(tokens).alias("end"), F.lit("").alias("rest"))
            ends = F.concat(x["spans"], F.array(last))
            between = F.transform(ends, lambda s, k: let(F.when(k == 0, 0).otherwise(F.get(ends, k - 1)["end"] + 1), lambda b: F.slice(x["scanned"], b + 1, s.start - b)))
            put = F.transform(x["spans"], lambda s: F.concat(F.lit('"[REDACTED]"'), s.rest))
            told = lambda p: F.array_join(F.transform(p, lambda y: y.text), "")
            return let(
                between,
                lambda parts: F.struct(
                    F.array_join(F.transform(parts, lambda p, k: F.concat(told(p), F.coalesce(F.get(put, k), F.lit("")))), "").alias("text"),
                    F.concat(F.array_repeat(F.lit("secret_kv"), F.size(x["spans"])), F.flatten(F.transform(F.flatten(parts), lambda y: y.rules))).alias("rules"),
                ),
            )

        return let(F.struct(spans.alias("spans"), scanned.alias("scanned")), rejoined)

    worth = F.rlike(text, F.lit(policy.prefilter() + (f"|{SECRET_FIELD}" if by_name else "")))
    return F.when(worth, let(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), walked)).otherwise(F.struct(text.alias("text"), none.alias("rules")))


def redact_entries(entries: DataFrame, policy: Policy | None = None) -> DataFrame:
    """``entries`` redacted, with redactions: the rules applied to message and attributes, and touched.

    Identifiers and correlation keys stay. Values of secret names are replaced at any depth of an attribute, objects and
    lists among them as a whole, and strings are scanned at any depth; names are not. What is found in ``raw`` is replaced but not counted, for it
    restates the other fields.
    """
    policy = policy or Policy()
    if not policy.active():
        return entries.withColumns({"redactions": F.array().cast("array<string>"), "touched": F.lit(False)})
    by_name = "secret_kv" in policy.active()
    none = F.array().cast("array<string>")

    def value(k: Column, v: Column) -> Column:
        kept = F.struct(v.alias("text"), none.alias("rules"))
        nested = v.startswith("{") | v.startswith("[")
        scanned = F.when(v.startswith('"'), redacted_string(v, policy)).when(nested, redacted_nested(v, policy)).otherwise(kept)
        if not by_name:
            return scanned
        secret = F.struct(F.lit('"[REDACTED]"').alias("text"), F.array(F.lit("secret_kv")).alias("rules"))
        return F.when(secret_name(k), F.when(v.isin("null", '""', "[]", "{}"), kept).otherwise(secret)).when(~F.rlike(v, F.lit(WORTH)), kept).otherwise(scanned)

    e = entries.withColumns({"r_raw": redacted(F.col("raw"), policy), "r_message": redacted(F.col("message"), policy), "r_attributes": F.transform_values("attributes", value)})
    found = F.concat(F.col("r_message.rules"), F.flatten(F.transform(F.map_values("r_attributes"), lambda x: x.rules)))
    e = e.withColumn("redactions", found)
    return e.withColumns(
        {
            "touched": (F.size("redactions") > 0) | (F.size("r_raw.rules") > 0),
            "raw": F.col("r_raw.text"),
            "message": F.col("r_message.text"),
            "attributes": F.transform_values("r_attributes", lambda _, x: x.text),
        }
    ).drop("r_raw", "r_message", "r_attributes")


def redaction_counts(redacted_entries: DataFrame) -> DataFrame:
    """(rule, n) over all entries."""
    each = redacted_entries.select(F.explode_outer("redactions").alias("rule"))  # a plain explode would scan the texts for a filter first
    return each.filter("rule is not null").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def redaction_totals(redacted_entries: DataFrame) -> DataFrame:
    """One row: entries_affected and total."""
    return redacted_entries.agg(F.count_if("touched").alias("entries_affected"), F.coalesce(F.sum(F.size("redactions")), F.lit(0)).alias("total"))

