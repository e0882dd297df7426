"""Personal data with DataFrame functions alone.

Regular expressions propose spans; what they propose must pass its check (Luhn for cards,
mod 97 for account numbers, part and digit counts for the rest), and words nearby raise
or lower its score.  Places come from the texts between matches: the pieces of a split
and the matches alternate, so a running sum of their lengths gives every start.  Sums
and words nearby are taken in blocks, so the time of a text grows with its length and its
matches, not with their square.

Patterns are anchored to the beginning of a run of their characters (or the end of the
last match) and take runs whole, so long runs without a match cost no more than reading
them; they find the same as the plain patterns in ``KINDS``.

Defined results: null text counts as empty (no spans); rows with the same id are read each
on its own; an empty table gives no rows; columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from spanloom.llm.common import text_or_empty

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

# kind, pattern, a letter or pattern without which a text cannot match, words nearby that speak for it.
KINDS = [
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    ("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", "@", "e-?mail|contact|write|mailto"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    ("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", r"\bip\b|address|host|server|login"),
    # [0-9]([\x20-]?[0-9])+ : whole runs with 14 to 19 digits
    ("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])", "", "card|visa|credit|debit"),
    # \+[0-9][\x20().0-9-]+[0-9]
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", r"phone|call|mobile|\btel\b|fax"),
    # Beyond the four above: account numbers, and social security numbers where words speak for them.
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", "",
     "iban|account|bank|konto"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", r"\bssn\b|social security|taxpayer"),
]
BASE = 4  # the first kinds, which every match that passes its check belongs to
NEAR = 40  # characters on either side that count as nearby
MATCHES, CHARS = 512, 1_024  # matches summed together, characters of a block that words nearby are read from
# Score by kind of a match that passed its check, what a word nearby adds, and the score from which a span counts.
SCORES, CONTEXT, LEAST = (0.9, 0.6, 0.8, 0.7, 0.9, 0.3), 0.1, 0.35


def luhn(digits: Column) -> Column:
    """From the last digit, every second one is doubled; the digit sums are a multiple of ten."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(
        i % 2 == 1, (d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5)).otherwise(d.cast("int")).cast("int"))
    return F.aggregate(values, F.lit(0), lambda total, v: total + v) % 10 == 0


def mod97(account: Column) -> Column:
    """The first four letters behind the rest, letters as 10 to 35: one more than a multiple of 97."""
    turned = F.concat(account.substr(F.lit(5), F.length(account)), account.substr(F.lit(1), F.lit(4)))
    def step(rest: Column, c: Column) -> Column:
        value = F.when(c >= "A", F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
        return ((rest * F.when(c >= "A", 100).otherwise(10) + value) % 97).cast("int")
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def passes(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(match, " ", "")) & F.length(F.regexp_replace(match, " ", "")).between(15, 34)
    return F.lit(True)


def proposed(text: Column, place: int) -> Column:
    """Matches of one kind; a text without the kind's needed letter is not searched."""
    _, pattern, needs, _ = KINDS[place]
    may = F.contains(text, F.lit(needs)) if needs else text.rlike("[0-9]")
    return F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once for the row, however often an inner function asks for it."""
    return F.get(F.transform(F.array(value), use), 0)


def placed(text: Column, matches: Column, place: int) -> Column:
    """The matches as spans: start, kind's place, end, found."""
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,found:string>>")

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["before"]
        end = start + F.length(pair["found"])
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(F.struct(
            start.alias("start"), F.lit(place).alias("kind"), end.alias("end"), pair["found"].alias("found")))).alias("spans"))

    def begins(blocks: Column) -> Column:
        """Where each block of matches begins to count."""
        sums = F.transform(blocks, lambda block: F.aggregate(
            block, F.lit(0), lambda total, p: total + p["before"] + F.length(p["found"])))
        return F.aggregate(sums, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("begun")),
                           lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["begun"], F.array(s["at"])).alias("begun")),
                           lambda s: s["begun"])

    def spans(blocks: Column) -> Column:
        return F.flatten(F.zip_with(blocks, begins(blocks), lambda block, at: F.aggregate(
            block, F.struct(at.alias("at"), empty.alias("spans")), step, lambda s: s["spans"])))

    # The last piece of the split lies behind the last match, so it pairs with null and is cut off.
    pairs = F.filter(F.zip_with(F.split(text, KINDS[place][1], -1), matches,
                                lambda b, m: F.struct(F.length(b).alias("before"), m.alias("found"))),
                     lambda p: p["found"].isNotNull())
    blocks = let(pairs, lambda ps: F.transform(F.sequence(F.lit(0), F.size(ps) - 1, F.lit(MATCHES)),
                                               lambda i: F.slice(ps, i + 1, MATCHES)))
    return F.when(F.size(matches) > 0, let(blocks, spans)).otherwise(empty)


def confirmed(text: Column, spans: Column, place: int) -> Column:
    """The spans that pass their check, with a score in place of what was found."""
    kind, _, _, words = KINDS[place]
    blocks = F.when(F.length(text) <= CHARS, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHARS}}}"), F.lit(0)))

    def scored(s: Column, blocks: Column) -> Column:
        begin, end = F.greatest(s["start"] - NEAR, F.lit(0)), s["end"] + NEAR
        first = F.floor(begin / CHARS).cast("int")
        held = F.array_join(F.slice(blocks, first + 1, F.floor(end / CHARS).cast("int") - first + 1), "")
        around = F.lower(F.substring(held, begin - first * CHARS + 1, end - begin))
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
                        (F.lit(SCORES[place]) + F.when(around.rlike(words), CONTEXT).otherwise(0.0)).alias("score"))

    passed = let(blocks, lambda bs: F.transform(F.filter(spans, lambda s: passes(kind, s["found"])), lambda s: scored(s, bs)))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,score:double>>")
    kept = F.when(F.size(spans) > 0, passed).otherwise(none)
    return kept if place < BASE else F.filter(kept, lambda s: s["score"] >= LEAST)


def written(spans: Column) -> Column:
    """kind:start:end by start and then kind, joined by commas."""
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans, scores (in the order of spans) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    every = range(len(KINDS))
    # Step by step, so that no search is evaluated twice.
    rows = rows.select("*", *[proposed(F.col("text"), k).alias(f"m{k}") for k in every])
    rows = rows.select("doc_id", "text", *[placed(F.col("text"), F.col(f"m{k}"), k).alias(f"p{k}") for k in every])
    rows = rows.select("doc_id", *[confirmed(F.col("text"), F.col(f"p{k}"), k).alias(f"s{k}") for k in every])
    rows = rows.withColumn("spans_", F.array_sort(F.concat(*[f"s{k}" for k in every])))
    base = F.filter("spans_", lambda s: s["kind"] < BASE)
    return rows.select(
        "doc_id", *[F.size(f"s{k}").cast("long").alias(f"n_{KINDS[k][0]}") for k in range(len(KINDS))],
        F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans_")).alias("spans"),
        F.transform("spans_", lambda s: s["score"]).alias("scores"))
