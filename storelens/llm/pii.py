"""Personal data: expressions propose spans, checks confirm them, words nearby adjust their score.

Proposals are leftmost, non-overlapping matches of each kind; one whose check fails is dropped and not
tried again. Checks: an ip's parts are at most 255, a card has 13 to 19 digits that pass Luhn, a phone
number 9 to 15 digits, an iban (in one piece or in groups of four) passes mod-97, a social security number has no
area, group or serial that is never given out, an assigned secret has letters and digits and ``LEAST_DISTINCT`` different
characters; access keys and private keys are told by their fixed form. A confirmed span scores 0.6; a word of its kind
within ``CONTEXT`` code points before it adds 0.3. Positions are code points, ends exclusive, and come
from the lengths of matches and of the text between them.

The expressions below match what the plain ones match, in time linear in the text: possessive
repeats, and a start only where a run of its characters starts or the last match ended.

Defined results: a null text is empty and has no span; each row is judged by itself, so repeated
rows get equal results; an empty table gives no rows. Other columns are not looked at and may have any name.
DataFrame functions only; no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, up_to

CONTEXT, BASE_SCORE, CONTEXT_SCORE = 40, 0.6, 0.3
LEAST_DISTINCT = 8
#: Matches whose positions are added up at a time: the sums of a text take time in proportion to its matches.
RUN = 512
SPAN_TYPE = "array<struct<kind:string,start:int,stop:int,score:double>>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """From the right every second digit is doubled, less 9 if over 9; the sum is a multiple of 10."""
    each = up_to(F.length(digits), lambda i: let(
        F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int") * (1 + i % 2), lambda d: d - F.when(d > 9, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod_97(iban: Column) -> Column:
    """The first four characters go last, letters become 10 to 35, the number leaves 1 when divided by 97."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    values = up_to(F.length(moved), lambda i: let(F.ascii(F.substr(moved, i + 1, F.lit(1))), lambda a: F.when(a < 58, a - 48).otherwise(a - 55)))
    return F.aggregate(values, F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def random_looking(m: Column) -> Column:
    """Whether the value that a name is given looks like a key: letters, digits, enough different characters."""
    return let(F.regexp_extract(m, r"([A-Za-z0-9_+/=-]{16,})$", 1), lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (
        F.size(F.array_distinct(F.split(v, ""))) >= LEAST_DISTINCT))


class Kind(NamedTuple):
    name: str
    pattern: str
    may_hold: Callable[[Column], Column]  # cheap and true wherever the pattern matches
    confirmed: Callable[[Column], Column]
    context: str


#: Fixed values of the contract: the first four kinds and their order.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda t: t.contains("@"), lambda m: F.lit(True), r"(?i)mail|contact|write"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         lambda t: t.rlike(r"[0-9]\.[0-9]"),
         lambda m: m.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9]?)(?:\.|$)){4}$"), r"(?i)\bip\b|address|host|server"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
         lambda m: let(_digits(m), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False)), r"(?i)card|credit|visa|pay"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.rlike(r"\+[0-9]"),
         lambda m: F.length(_digits(m)).between(9, 15), r"(?i)phone|call|\btel|mobile|fax"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+", lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}[A-Z0-9]"), mod_97, r"(?i)iban|bank|account"),
    Kind("iban_spaced", r"\b[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[0-9]{1,3})?\b", lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20[A-Z0-9]"),
         lambda m: let(F.replace(m, F.lit(" "), F.lit("")), mod_97), r"(?i)iban|bank|account"),
    Kind("phone_local", r"\([0-9]{3}\)[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}\b", lambda t: t.rlike(r"\([0-9]{3}\)"),
         lambda m: F.lit(True), r"(?i)phone|call|\btel|mobile|fax"),
    Kind("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]"),
         lambda m: ~m.rlike("^(?:000|666|9..)|-00-|0000$"), r"(?i)ssn|social|security"),
    Kind("secret", r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_+/=-]{16,}",
         lambda t: t.rlike(r"(?i)token|secret|passw|key"), random_looking, r"(?i)auth|login|credential|config"),
    Kind("access_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36}\b|-----BEGIN [A-Z ]*PRIVATE KEY-----",
         lambda t: t.rlike(r"AKIA|ASIA|gh[pousr]_|PRIVATE KEY"), lambda m: F.lit(True), r"(?i)key|secret|auth"),
)
BASE_KINDS = 4


def spans_of(text: Column, kind: Kind) -> Column:
    """Confirmed spans of one kind, in order."""
    def run(x: Column, first: Column) -> Column:
        """The starts of the matches of one run, from the end of the match before it, and the run's length."""
        state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        return F.aggregate(up_to(F.least(F.lit(RUN), F.size(x["m"]) - first), lambda i: first + i), state, lambda s, i: let(
            s["at"] + F.char_length(F.get(x["p"], i)), lambda a: F.struct(
                (a + F.char_length(F.get(x["m"], i))).alias("at"), F.array_append(s["starts"], a).alias("starts"))))

    def located(x: Column) -> Column:
        def placed(runs: Column) -> Column:
            zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("firsts"))
            firsts = F.aggregate(runs, zero, lambda s, r: F.struct(
                (s["at"] + r["at"]).alias("at"), F.array_append(s["firsts"], s["at"]).alias("firsts")))["firsts"]
            return F.flatten(F.zip_with(runs, firsts, lambda r, a: F.transform(r["starts"], lambda b: a + b)))

        starts = let(up_to(F.ceil(F.size(x["m"]) / RUN).cast("int"), lambda k: run(x, k * RUN)), placed)
        return F.zip_with(starts, x["m"], lambda a, m: F.struct(a.alias("start"), m.alias("m")))

    def scored(s: Column) -> Column:
        low = F.greatest(s["start"] - CONTEXT, F.lit(0))
        near = F.substr(text, low + 1, s["start"] - low).rlike(kind.context)
        return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), (s["start"] + F.char_length(s["m"])).alias("stop"),
                        (BASE_SCORE + F.when(near, CONTEXT_SCORE).otherwise(0.0)).cast("double").alias("score"))

    found = F.struct(F.split(text, kind.pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("m"))
    all_ = let(found, lambda x: F.transform(F.filter(located(x), lambda s: kind.confirmed(s["m"])), scored))
    return F.when(kind.may_hold(text), all_).otherwise(F.array()).cast(SPAN_TYPE)


def find_pii(documents: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS, **keep: str) -> DataFrame:
    """For each row the columns ``keep`` (new name = column) and an array of spans for each kind, named after it."""
    t = F.coalesce(F.col(text), F.lit(""))
    return documents.select(*[F.col(c).alias(n) for n, c in keep.items()], t.alias("text")).select(
        *keep, "text", *[spans_of(F.col("text"), k).alias(k.name) for k in kinds])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def pii_report(documents: DataFrame) -> DataFrame:
    names = [k.name for k in KINDS]
    base, found = names[:BASE_KINDS], find_pii(documents, doc_id="doc_id")
    all_ = found.select("doc_id", F.struct(*names).alias("f"))
    base_spans, spans = (F.concat(*[F.col(f"f.{n}") for n in some]) for some in (base, names))
    out = all_.select("doc_id", *[F.size(f"f.{n}").cast("bigint").alias(f"n_{n}") for n in names],
                      _joined(base_spans).alias("base"), _joined(spans).alias("spans"),
                      F.size(F.filter(spans, lambda s: s["score"] > BASE_SCORE)).cast("bigint").alias("n_context"))
    return out.select("doc_id", *[f"n_{n}" for n in names], F.sha2("base", 256).alias("base_sha256"), "spans", "n_context")
