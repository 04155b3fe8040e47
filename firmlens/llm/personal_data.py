"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Patterns and a gazetteer propose spans, the four strict kinds among them: listed given names followed by a
capitalised word, and house numbers followed by a name and a listed street word. Labelers (pattern checks,
the gazetteer's lists of names, streets, mail domains, dialling codes and account countries, cue words, the
characters around a span) each vote for, against or not at all. The votes are counted by pattern
over all documents; expectation-maximisation on those counts estimates how reliable each labeler is
and how likely each pattern of votes is to be personal data; a logistic span classifier is fitted to
these probabilities and decides over the spans that the strict kinds do not settle. The strict
spans stay whatever the classifier says.

Everything that runs on documents is a column expression. Only the table of vote patterns reaches
the driver; it has at most kinds * 3^labelers rows at any input size. Matches are located in blocks,
and what surrounds them is cut from pieces of the text, so the work of a text grows with its matches.

Null and empty texts hold no spans. Repeated rows are scanned each on its own. Offsets count code points.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.llm.registry import query, table
from firmlens.llm.scratch import stored

#: Kind, pattern, and a character that must occur in the text. Possessive quantifiers and the look-behind
#: (or the end of the last match, \G) only save backtracking: they match what the plain patterns match.
STRICT = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[\x20-]?+[0-9])++", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
#: Tokens and names are taken whole at any length; a full stop after a secret is not part of it.
PROPOSED = {
    "secret": (r'(?i)(?<![A-Za-z])(?:token|password|passwd|secret|api[_-]?key)\x20?[=:]\x20?"?[0-9A-Za-z_./+=-]{11,}[0-9A-Za-z_/+=-]"?', None),
    "mail_words": (r"(?i)(?:\G|(?<![a-z0-9._-]))[a-z0-9._-]{2,}+\x20?[(\[]at[)\]]\x20?[a-z0-9-]++\x20?[(\[]dot[)\]]\x20?[a-z]{2,}+", None),
    "phone_local": (r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", None),
    "ssn": (r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-"),
    "iban": (r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![0-9A-Za-z])", None),
}
# The gazetteer. Given names that are no common words, street words, mail domains, dialling codes, countries of account numbers.
GIVEN_NAMES = """Anna Maria John Peter Thomas Michael David Sarah Laura Julia Robert James Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica
Karen Nancy Margaret Sandra William Richard Joseph Charles Christopher Daniel Matthew Anthony Donald Steven Andrew Kenneth George Joshua Kevin Brian
Edward Ronald Timothy Jason Jeffrey Pierre Jean Marie Sophie Camille Hans Klaus Jürgen Wolfgang Stefan Andreas Sabine Petra Ursula Monika Carlos José
Juan Luis Carmen Ana Isabel Lucía Pablo Diego""".split()
STREETS = "Street St Avenue Ave Road Rd Lane Boulevard Blvd Drive Square Court Way".split()
MAIL_DOMAINS = "gmail.com yahoo.com hotmail.com outlook.com aol.com icloud.com gmx.de gmx.net web.de t-online.de orange.fr free.fr wanadoo.fr live.com proton.me".split()
DIALLING = "+1 +33 +34 +39 +44 +49".split()
ACCOUNTS = "AT BE CH CZ DE DK ES FI FR GB GR HU IE IT LU NL NO PL PT SE".split()
PROPOSED |= {
    "name": (r"(?<![\p{L}\p{N}])(?:" + "|".join(GIVEN_NAMES) + r")\x20\p{Lu}\p{Ll}++(?:-\p{Lu}\p{Ll}++)?+", None),
    "address": (r"(?<![\p{L}\p{N}.,-])[0-9]{1,5}+\x20(?:\p{Lu}[\p{L}.'-]*+\x20){1,3}?(?:" + "|".join(STREETS) + r")(?![\p{L}\p{N}])", None),
}
KINDS = [*STRICT, *PROPOSED]
#: Words before a span that speak for or against personal data.
FOR_WORDS = r"(?i)mail|phone|tel[.:]|call|fax|mobile|contact|card|visa|iban|account|ssn|social security|token|password|secret|key|login|ip[: ]|host"
AGAINST_WORDS = r"(?i)version|isbn|issn|doi|order no|page|figure|table|section|article|release"
LABELERS = ["check", "gazetteer", "near_for", "near_against", "shape", "apart", "variety"]
CONTEXT = 24
#: Matches located together, and characters of the pieces that contexts are cut from.
BLOCK, PIECE = 64, 4096

_SPANS = "array<struct<kind:string,s:int,e:int,v:string,strict:boolean>>"


def _luhn(digits: Column) -> Column:
    def worth(acc, i):
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), worth) % 10 == 0


def _passes(kind: str, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3)
                        & (F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(kind == "email")


def _blocks(hits: Column) -> Column:
    return F.when(F.size(hits) > 0, F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))


def _block_sizes(hits: Column, gaps: Column) -> Column:
    """Characters that each block of matches takes, with the text before every match."""
    def total(lengths: Column) -> Column:
        return F.aggregate(lengths, F.lit(0), lambda a, n: a + n)

    return F.transform(_blocks(hits), lambda i: total(F.slice(gaps, i * BLOCK + 1, F.lit(BLOCK))) + total(F.transform(F.slice(hits, i * BLOCK + 1, F.lit(BLOCK)), F.length)))


def _block_starts(sizes: Column) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(sizes, start, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def _located(kind: str, hits: Column, gaps: Column, starts: Column) -> Column:
    """Spans of the matches; ``gaps`` are the lengths of the text before each of them."""
    none = F.array().cast(_SPANS)

    def block(i):
        def add(acc, j):
            hit = F.get(hits, j)
            start = acc["at"] + F.get(gaps, j)
            end = start + F.length(hit)
            span = F.struct(F.lit(kind).alias("kind"), start.alias("s"), end.alias("e"), hit.alias("v"), _passes(kind, hit).alias("strict"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).cast(_SPANS).alias("out"))

        inside = F.sequence(i * BLOCK, F.least((i + 1) * BLOCK, F.size(hits)) - 1)
        return F.aggregate(inside, F.struct(F.get(starts, i).alias("at"), none.alias("out")), add, lambda acc: acc["out"])

    return F.when(F.size(hits) > 0, F.flatten(F.transform(_blocks(hits), block))).otherwise(none)


def _cut(pieces: Column, start: Column, length: Column) -> Column:
    """At most PIECE characters of a text that comes in pieces."""
    i = F.floor(start / PIECE).cast("int")
    return F.substr(F.concat(F.coalesce(F.get(pieces, i), F.lit("")), F.coalesce(F.get(pieces, i + 1), F.lit(""))), start - i * PIECE + 1, length)


def _listed(x: Column) -> Column:
    """What the gazetteer says about a span."""
    v, kind = x["v"], x["kind"]
    domain = F.lower(F.regexp_extract(v, "@([^@]*)$", 1))
    known = F.when(kind.isin("name", "address"), True).when(kind == "email", domain.isin(MAIL_DOMAINS)).when(
        kind == "phone", v.rlike(r"^(?:" + "|".join(c.replace("+", r"\+") for c in DIALLING) + r")[\x20().-]")).when(kind == "iban", F.substring(v, 1, 2).isin(ACCOUNTS))
    return F.when(known, 1).when((kind == "iban") & ~known, -1).otherwise(0)


def _votes(pieces: Column, x: Column) -> dict[str, Column]:
    v, kind = x["v"], x["kind"]
    before = _cut(pieces, F.greatest(x["s"] - CONTEXT, F.lit(0)), F.least(x["s"], F.lit(CONTEXT)))
    around = F.concat(_cut(pieces, F.greatest(x["s"] - 1, F.lit(0)), F.when(x["s"] > 0, 1).otherwise(0)), _cut(pieces, x["e"], F.lit(1)))
    distinct = F.size(F.array_distinct(F.split(F.lower(v), "")))
    yes, no = lambda c: F.when(c, 1).otherwise(0), lambda c: F.when(c, -1).otherwise(0)
    return {
        "check": F.when(x["strict"], 1).when(kind.isin(*STRICT), -1).otherwise(0),
        "gazetteer": _listed(x),
        "near_for": yes(F.concat(before, F.when(kind == "secret", v).otherwise("")).rlike(FOR_WORDS)),
        "near_against": no(before.rlike(AGAINST_WORDS)),
        "shape": F.when(v.rlike(r"[@()+=:]|[0-9][\x20.-][0-9]"), 1).otherwise(0),
        "apart": F.when(around.rlike(r"[0-9A-Za-z_#/]"), -1).otherwise(1),
        "variety": F.when(distinct >= 5, 1).when(distinct <= 2, -1).otherwise(0),
    }


def _held(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """Columns behind a generator, so that each is computed once and not again in every lambda that looks at it."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def candidates(documents: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and an array ``cands`` of spans with their votes, in order of kind and place."""
    text, patterns = F.col("text"), STRICT | PROPOSED
    names = list(dict.fromkeys([*keep, "text"]))
    hits, gaps, sizes = ({k: F.col(f"__{what}_{k}") for k in patterns} for what in ("hits", "gaps", "sizes"))

    def every(kind: str) -> Column:
        pattern, needs = patterns[kind]
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        return F.when(F.contains(text, F.lit(needs)), found) if needs else found

    def lengths(kind: str) -> Column:
        return F.when(F.size(hits[kind]) > 0, F.transform(F.split(text, patterns[kind][0], -1), F.length))

    held = _held(documents, names, **{f"__hits_{k}": every(k) for k in patterns})
    held = _held(held, [*names, *hits.values()], **{f"__gaps_{k}": lengths(k) for k in patterns})
    held = _held(held, [*names, *hits.values(), *gaps.values()], **{f"__sizes_{k}": _block_sizes(hits[k], gaps[k]) for k in patterns})
    held = _held(held, [*names, *hits.values(), *gaps.values()], **{f"__starts_{k}": _block_starts(sizes[k]) for k in patterns})
    spans = F.concat(*[_located(k, hits[k], gaps[k], F.col(f"__starts_{k}")) for k in patterns])
    pieces = F.when(F.size("__spans") > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))
    held = _held(held, names, __spans=spans)
    held = _held(held, [*keep, "__spans"], __pieces=pieces, __strict=F.filter("__spans", lambda x: x["strict"]))

    def with_votes(x):
        return F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["strict"].alias("strict"),
                        *[c.cast("int").alias(n) for n, c in _votes(F.col("__pieces"), x).items()])

    free = F.filter("__spans", lambda x: ~x["kind"].isin(*PROPOSED) | ~F.exists("__strict", lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])))
    return held.select(*keep, F.transform(free, with_votes).alias("cands"))


def reliabilities(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 60) -> tuple[dict, list[float]]:
    """EM over counted vote patterns: (votes' likelihood per class and labeler, probability per pattern)."""
    n = len(LABELERS)
    share = [min(0.95, max(0.05, 0.5 + 0.15 * sum(votes))) for _, votes, _ in patterns]
    table_: dict = {}
    for _ in range(rounds):
        total = [sum(c * (p if y else 1 - p) for (_, _, c), p in zip(patterns, share)) for y in (0, 1)]
        prior = {k: [1.0, 1.0] for k in KINDS}
        table_ = {(j, v, y): 1.0 for j in range(n) for v in (-1, 0, 1) for y in (0, 1)}
        for (kind, votes, count), p in zip(patterns, share):
            for y, part in ((0, 1 - p), (1, p)):
                prior[kind][y] += count * part
                for j, v in enumerate(votes):
                    table_[j, v, y] += count * part
        table_ = {(j, v, y): c / (total[y] + 3) for (j, v, y), c in table_.items()}
        share = []
        for kind, votes, _ in patterns:
            odds = math.log(prior[kind][1] / prior[kind][0]) + sum(math.log(table_[j, v, 1] / table_[j, v, 0]) for j, v in enumerate(votes))
            share.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return table_, share


class SpanClassifier:
    """Logistic weights of kinds and votes."""

    def __init__(self, kinds: dict[str, float], votes: list[float]):
        self.kinds, self.votes = kinds, votes

    def score(self, x: Column) -> Column:
        total = F.lit(0.0)
        for k, w in self.kinds.items():
            total = total + F.when(x["kind"] == k, w).otherwise(0.0)
        for name, w in zip(LABELERS, self.votes):
            total = total + x[name] * F.lit(w)
        return total


def fit(patterns: list[tuple[str, tuple[int, ...], int]], steps: int = 300) -> SpanClassifier:
    """Weighted logistic regression on the probabilities that EM gives the vote patterns."""
    _, share = reliabilities(patterns)
    kinds, votes = {k: 0.0 for k in KINDS}, [0.0] * len(LABELERS)
    whole = sum(math.log1p(c) for _, _, c in patterns) or 1.0
    for _ in range(steps):
        dk, dv = {k: -1e-3 * w for k, w in kinds.items()}, [-1e-3 * w for w in votes]
        for (kind, pattern, count), p in zip(patterns, share):
            z = kinds[kind] + sum(w * v for w, v in zip(votes, pattern))
            miss = (p - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) * math.log1p(count) / whole
            dk[kind] += miss
            dv = [d + miss * v for d, v in zip(dv, pattern)]
        kinds = {k: w + 4 * dk[k] for k, w in kinds.items()}
        votes = [w + 4 * d for w, d in zip(votes, dv)]
    return SpanClassifier(kinds, votes)


def train(found: DataFrame) -> SpanClassifier:
    """Counts the vote patterns of all candidates (at most 11 * 3^7 groups) and fits the classifier."""
    counted = (found.select(F.explode("cands").alias("x")).groupBy("x.kind", *[F.col(f"x.{n}").alias(n) for n in LABELERS])
               .agg(F.count(F.lit(1)).alias("n")).collect())
    return fit(sorted((r["kind"], tuple(r[n] for n in LABELERS), r["n"]) for r in counted))


def _place(x: Column) -> Column:
    """Order of spans: by start, then by kind as listed."""
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), x["kind"])
    return F.struct(x["s"].alias("s"), number.alias("k"), x["e"].alias("e"), x["kind"].alias("kind"), x["strict"].alias("strict"))


def decided(found: DataFrame, model: SpanClassifier) -> DataFrame:
    """``spans``: the strict spans and those that the classifier accepts, in order."""
    kept = F.filter("cands", lambda x: x["strict"] | (x["kind"].isin(*PROPOSED) & (model.score(x) > 0)))
    return found.withColumn("spans", F.array_sort(F.transform(kept, _place))).drop("cands")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def personal_data(documents: DataFrame) -> DataFrame:
    """(doc_id, spans): spans as an array of (s, k, e, kind, strict)."""
    found = stored(candidates(documents, ["doc_id"]), "candidates")
    return decided(found, train(found))


@query("op8_weakly_supervised_spans")
def op8_weakly_supervised_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    strict = F.filter(spans, lambda x: x["strict"])

    def count(kind: str) -> Column:
        return F.size(F.filter(strict, lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return personal_data(table(spark, sf_dir, "documents")).select(
        "doc_id", *[count(k) for k in STRICT],
        F.sha2(_joined(strict), 256).alias("base_sha256"), _joined(spans).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets."""
    def step(acc, x):
        fresh = x["s"] >= acc["at"]
        piece = F.concat(F.substr(text, acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0))), F.lit("["), x["kind"], F.lit("]"))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], F.when(fresh, piece).otherwise("")).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; personal data in its text is replaced, and n_chars follows where it was the text's length.

    Other columns pass through as they are, whatever their names: they travel as one struct. The candidates
    are stored with the documents, so each text is searched once.
    """
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.col("text"))
    found = stored(candidates(held, ["row", "text"]), "candidates")
    spans = F.col("spans")
    new = decided(found, train(found)).select("row", F.length("text").alias("n"), F.inline(F.array(F.struct(
        F.when(F.size(spans) > 0, redacted(F.col("text"), spans)).otherwise(F.col("text")).alias("new")))))
    types = dict(docs.dtypes)

    def out(c: str) -> Column:
        if c == "text":
            return F.col("new")
        old = F.col("row")[c]
        return F.when(old == F.col("n"), F.length("new")).otherwise(old).cast(types[c]) if c == "n_chars" else old

    return new.select(*[out(c).alias(c) for c in docs.columns])
