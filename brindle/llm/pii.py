"""Personal data by weak supervision, in DataFrame functions only.

Strict patterns find the base spans. Wider patterns add candidates. Three labelers vote on each
candidate or abstain: a regex labeler on its form, a gazetteer labeler on the part that names an
issuer, domain or range, and a context labeler on the words before it. How often each pattern of
votes occurs is counted over all candidates of all documents; expectation-maximisation on those
counts estimates the labelers' reliabilities, and a logistic span classifier is trained on the
resulting posteriors, from counts of feature patterns that are bounded whatever the input.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.columns import given, named
from brindle.llm.scratch import Scratch

KINDS = ("email", "ip", "card", "phone")
SPAN = "struct<start:int,end:int,s:string>"
CONTEXT = 40

#: Stands for a separator inside a run; texts that hold it get U+0002 in its place while they are searched.
MARK = "\x01"

# Patterns over texts whose inner separators are marked. A search starts at the first character of
# a run or where the last match ended: where a match fails from there, it fails from within the run.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+\x01-]))[A-Za-z0-9._%+\x01-]++@[A-Za-z0-9-]++\x01[A-Za-z0-9\x01-]*+"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9][0-9\x01]{15,}+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Wider forms.
_EMAIL_WIDE = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[](?:dot|DOT)[)\]]) ?[A-Za-z0-9-]{1,63}){1,8}"
_PHONE_WIDE = r"(?<![0-9+.(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])"
_CARD_WIDE = r"(?<![0-9.-])[0-9]{4}[ -]?[0-9]{4,6}[ -]?[0-9]{4,6}(?:[ -]?[0-9]{3,4})?(?![0-9-])"

#: Gazetteer and context words.
DOMAINS = "com|org|net|edu|gov|io|info|biz|de|fr|es|it|uk|eu|us|ch|at|nl"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|correo|courriel|kontakt)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|from|client|adresse)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|carte|karte|tarjeta|payment)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|cell|telefon|tel[eé]fono|t[eé]l[eé]phone)\b",
}
AGAINST = r"(?i)\b(?:isbn|version|v|order|invoice|ref|sku|serial|page|figure)\b[^\n]{0,8}$"


def spans_of(text: Column, pattern: str) -> Column:
    """array of (start, end, s) of a pattern's leftmost non-overlapping matches, in code points."""
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(pieces.alias("p"), matches.alias("m"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("s"))
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out")))

    return F.aggregate(pairs, zero, step, lambda acc: acc["out"])


def digits(s: Column) -> Column:
    return F.regexp_replace(s, r"[^0-9]+", "")


def luhn(d: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        x = F.substring(d, -i, F.lit(1)).cast("int") * (2 - i % 2)
        return acc + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def valid_ip(s: Column) -> Column:
    parts = F.split(s, r"\.")
    trimmed = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(parts, lambda p: (F.length(trimmed(p)) <= 3) & (F.lpad(trimmed(p), 3, "0") <= "255"))


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _apart(wide: Column, base: Column) -> Column:
    """Spans of `wide` that touch no span of `base`."""
    return F.filter(wide, lambda w: ~F.exists(base, lambda b: (w["start"] < b["end"]) & (b["start"] < w["end"])))


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(given, _base, _wide, _t): the columns of docs packed in a struct, beside structs of one array of
    spans for each kind, and the text (null: empty)."""
    t = F.coalesce(F.col(text), F.lit(""))
    has = lambda pattern: F.col("_t").rlike(pattern)
    at = F.col("_t").contains("@")
    numbers = has(r"[0-9]{3}")
    marked = lambda pattern: F.regexp_replace(F.translate("_t", MARK, "\x02"), pattern, MARK)
    # Marked and digit-bearing copies are null where the text can hold no match: a base card has at
    # least 16 digits, a separator at most between two; the wider forms begin with three digits in a row.
    staged = docs.select(given(docs), t.alias("_t")).select(
        "*",
        F.when(at, marked(r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])")).alias("_e"),
        F.when(has(r"(?:[0-9][\x20-]?+){15}[0-9]"), marked(r"(?<=[0-9])[\x20-](?=[0-9])")).alias("_c"),
        F.when(has(r"[0-9]\.[0-9]+\.[0-9]"), F.col("_t")).alias("_i"),
        F.when(F.col("_t").contains("+"), F.col("_t")).alias("_p"),
        F.when(numbers, F.col("_t")).alias("_n"),
        F.when(F.lower("_t").rlike(r"[(\[]at[)\]]"), F.col("_t")).alias("_a"),
    )
    found = lambda column, pattern: F.coalesce(spans_of(F.col(column), pattern), _none())
    span = lambda x, s: F.struct(x["start"].alias("start"), x["end"].alias("end"), s.alias("s"))
    own = lambda x: F.substring(F.col("_t"), x["start"] + 1, x["end"] - x["start"])
    staged = staged.withColumn(
        "_base",
        F.struct(
            F.transform(found("_e", _EMAIL), lambda x: span(x, own(x))).alias("email"),
            F.filter(found("_i", _IP), lambda x: valid_ip(x["s"])).alias("ip"),
            F.filter(
                F.transform(found("_c", _CARD), lambda x: span(x, own(x))),
                lambda x: F.length(digits(x["s"])).between(16, 19) & luhn(digits(x["s"])),
            ).alias("card"),
            F.filter(found("_p", _PHONE), lambda x: F.length(digits(x["s"])).between(8, 15)).alias("phone"),
        ),
    )
    return staged.withColumn(
        "_wide",
        F.struct(
            _apart(found("_a", _EMAIL_WIDE), F.col("_base.email")).alias("email"),
            _none().alias("ip"),
            F.filter(
                _apart(found("_n", _CARD_WIDE), F.concat("_base.card", "_base.phone")), lambda x: F.length(digits(x["s"])).between(13, 19) & luhn(digits(x["s"])),
            ).alias("card"),
            _apart(found("_n", _PHONE_WIDE), F.concat("_base.phone", "_base.card")).alias("phone"),
        ),
    ).drop("_e", "_c", "_i", "_p", "_n", "_a")


def _labelled(kind: str, spans: Column, base: bool) -> Column:
    """Spans with the labelers' votes (1, -1 or 0) and a feature: length in classes."""
    s_of = {
        "email": lambda s: F.when(F.lower(s).rlike(rf"(?:\.|[(\[]dot[)\]] ?)(?:{DOMAINS})$"), 1).otherwise(0),
        "ip": lambda s: F.when(s.rlike(r"^0*(?:0|22[4-9]|2[3-5][0-9])\."), -1).otherwise(1),
        "card": lambda s: F.when(digits(s).rlike(ISSUERS), 1).otherwise(-1),
        "phone": lambda s: F.when(F.length(digits(s)).between(10, 13), 1).otherwise(0),
    }
    form = {
        "email": lambda s: F.lit(1 if base else 0),
        "ip": lambda s: F.lit(1),
        "card": lambda s: F.lit(1) if base else F.when(luhn(digits(s)), 1).otherwise(-1),
        "phone": lambda s: F.lit(1 if base else 0),
    }

    def label(x: Column) -> Column:
        # The words right before a span, its own line only.
        before = F.substring(F.col("_t"), F.greatest(x["start"] - CONTEXT, F.lit(0)) + 1, F.least(x["start"], F.lit(CONTEXT)))
        near = F.element_at(F.split(before, "\n"), -1)
        context = F.when(near.rlike(CUES[kind]), 1).when(near.rlike(AGAINST), -1).otherwise(0)
        return F.struct(
            F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lit(base).alias("base"),
            form[kind](x["s"]).alias("v0"), s_of[kind](x["s"]).alias("v1"), context.alias("v2"),
            F.least(F.floor(F.length(x["s"]) / 8), F.lit(4)).cast("int").alias("size"),
        )

    return F.transform(spans, label)


def with_labels(docs: DataFrame, text: str = "text") -> DataFrame:
    """(given, _t, _spans): every candidate with its votes and features."""
    found = with_candidates(docs, text)
    parts = [_labelled(k, F.col(f"_{where}.{k}"), where == "base") for k in KINDS for where in ("base", "wide")]
    return found.withColumn("_spans", F.concat(*parts)).drop("_base", "_wide")


def pattern_counts(labelled: DataFrame) -> list[tuple]:
    """Counts of (kind, votes, size class) over all candidates: at most 4 * 27 * 5 rows."""
    keys = ["x.kind", "x.v0", "x.v1", "x.v2", "x.size"]
    rows = labelled.select(F.explode("_spans").alias("x")).groupBy(*keys).count().collect()
    return sorted(tuple(r) for r in rows)


def fit_labelers(counts: Iterable[tuple], rounds: int = 25) -> dict[tuple, float]:
    """Posterior of being personal data for each pattern of votes, by expectation-maximisation.

    Each labeler has one reliability a kind (how often its votes are right), held in (0.55, 0.98) so
    that it can't turn round; kinds are fitted apart.
    """
    posts: dict[tuple, float] = {}
    by_kind = defaultdict(lambda: defaultdict(int))
    for kind, *votes, _, n in counts:
        by_kind[kind][tuple(votes)] += n
    for kind, patterns in by_kind.items():
        prior, right = 0.5, [0.8, 0.7, 0.7]
        post = {}
        for _ in range(rounds):
            for votes in patterns:
                z = math.log(prior / (1 - prior)) + sum(v * math.log(r / (1 - r)) for v, r in zip(votes, right, strict=True))
                post[votes] = 1 / (1 + math.exp(-z))
            total = sum(patterns.values())
            prior = min(0.95, max(0.05, (sum(post[v] * n for v, n in patterns.items()) + 1) / (total + 2)))
            for j in range(3):
                hit = sum(n * (post[v] if v[j] > 0 else 1 - post[v]) for v, n in patterns.items() if v[j])
                seen = sum(n for v, n in patterns.items() if v[j])
                right[j] = min(0.98, max(0.55, (hit + 4 * [0.8, 0.7, 0.7][j]) / (seen + 4)))
        posts |= {(kind, *v): p for v, p in post.items()}
    return posts


def train_classifier(counts: Iterable[tuple], posts: dict[tuple, float], steps: int = 400, rate: float = 0.5) -> dict[tuple, float]:
    """Weights of a logistic classifier of spans, on posteriors as soft labels; features are one-hot."""
    rows = [(_features(k, a, b, c, s), posts[k, a, b, c], n) for k, a, b, c, s, n in counts]
    weights: dict[tuple, float] = defaultdict(float)
    total = sum(n for *_, n in rows) or 1
    for _ in range(steps):
        slope: dict[tuple, float] = defaultdict(float)
        for features, p, n in rows:
            z = sum(weights[f] for f in features)
            for f in features:
                slope[f] += n / total * (p - 1 / (1 + math.exp(-z)))
        for f, g in slope.items():
            weights[f] += rate * (g - 1e-4 * weights[f])
    return dict(weights)


def _features(kind: str, v0: int, v1: int, v2: int, size: int) -> list[tuple]:
    return [("kind", kind), ("v0", kind, v0), ("v1", kind, v1), ("v2", kind, v2), ("size", kind, size)]


def classified(labelled: DataFrame, counts: list[tuple], weights: dict[tuple, float]) -> DataFrame:
    """`_spans` reduced to base spans and those that the classifier takes, each with its probability p."""
    names = sorted({r[:5] for r in counts})
    table = {n: 1 / (1 + math.exp(-sum(weights.get(f, 0.0) for f in _features(*n)))) for n in names}
    key = lambda x: F.concat_ws("|", x["kind"], *[x[c].cast("string") for c in ("v0", "v1", "v2", "size")])
    flat = [F.lit(v) for n, p in table.items() for v in ("|".join(map(str, n)), p)]
    chances = F.create_map(*flat) if flat else F.create_map().cast("map<string,double>")
    scored = F.transform("_spans", lambda x: x.withField("p", F.when(F.size("_spans") > 0, F.element_at(chances, key(x)))))
    return labelled.withColumn("_spans", F.filter(scored, lambda x: x["base"] | (x["p"] >= 0.5)))


def _found(docs: DataFrame, text: str) -> DataFrame:
    labelled = with_labels(docs, text)
    counts = pattern_counts(labelled)
    return classified(labelled, counts, train_classifier(counts, fit_labelers(counts)))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `_spans`, which replaces a column of that name: (kind, start, end, base, votes, p), in
    code points, end exclusive.

    Null and empty texts have no spans; repeated rows are searched alike; an empty table gives an
    empty result; other columns pass through, whatever their names. Narrow: texts are neither
    shuffled nor stored.
    """
    return _found(docs, text).select(*named(docs.columns, "_spans"), "_spans")


def find_ids(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As find(), with only the key beside the spans: texts are searched once, candidates stored."""
    own = with_labels(docs.select(key, text), text).select(F.col(f"given.{key}").alias(key), "_spans")
    labelled = Scratch(docs.sparkSession, "pii").save(own, "spans")
    counts = pattern_counts(labelled)
    return classified(labelled, counts, train_classifier(counts, fit_labelers(counts)))


def listed(spans: Column, base_only: bool) -> Column:
    """kind:start:end of spans, by kind in the order of KINDS and then by start, comma-joined."""

    def of_kind(kind: str) -> Column:
        own = F.filter(spans, lambda x: (x["kind"] == kind) & (x["base"] if base_only else F.lit(True)))
        ordered = F.sort_array(F.transform(own, lambda x: F.struct(x["start"].alias("a"), x["end"].alias("b"))))
        return F.transform(ordered, lambda x: F.concat_ws(":", F.lit(kind), x["a"].cast("string"), x["b"].cast("string")))

    return F.array_join(F.concat(*map(of_kind, KINDS)), ",")


def redacted(text: Column, spans: Column) -> Column:
    """text with each span, overlapping ones as one, replaced by its kind in angle brackets."""
    ordered = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("a"), x["end"].alias("b"), x["kind"].alias("k"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, x["a"] - acc["at"])
        return F.when(x["a"] < acc["at"], F.struct(F.greatest(acc["at"], x["b"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(x["b"].alias("at"), F.concat(acc["out"], gap, F.lit("<"), F.upper(x["k"]), F.lit(">")).alias("out"))
        )

    done = F.aggregate(ordered, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """docs with personal data masked in the text and n_chars, if there is such a column, counted anew.

    Texts without personal data, null and empty ones too, stay as they are; other columns pass
    through, whatever their names; an empty table gives an empty result.
    """
    masked = redacted(F.col(f"given.{text}"), F.col("_spans"))
    out = _found(docs, text).select("given", masked.alias("_masked"), (F.size("_spans") > 0).alias("_hit"))
    columns = named(docs.columns)
    for i, c in enumerate(docs.columns):
        if c == text:
            columns[i] = F.col("_masked").alias(c)
        elif c == n_chars:
            columns[i] = F.when(F.col("_hit"), F.length("_masked").cast(docs.schema[c].dataType)).otherwise(columns[i]).alias(c)
    return out.select(*columns)
