"""Personal data in texts: base patterns, and candidate spans that gradient-boosted trees select.

Base spans are the leftmost matches of one pattern per kind that pass the kind's test (digits, parts, Luhn).
They miss spans whose neighbours run into the match: two card numbers with a blank between them are one
match of 32 digits. So further patterns of high recall propose spans that may overlap, and boosted trees
over format (length, digits, separators, checks) and context (neighbouring characters, digits and keywords
nearby) score them.

No table marks personal data, so the trees learn from the base patterns: a match that passes its test is
positive; a match that fails it, and a passing match with its next word or without its last part, negative.
Proposals are only scored. A quarter of the labelled spans, by hash, is kept from the trees: pooled adjacent
violators over score bins turn it into calibrated probabilities, and a kind's threshold is the lowest score
from which on the probability is at least ``precision``. A kind without enough such spans selects nothing.

Everything up to the final spans is DataFrame expressions on one row at a time, in time that grows with the
text; the trees are fitted by MLlib on all labelled spans, equal ones as one weighted row, and applied as expressions.

Defined results: null and empty texts have no spans. Repeated rows are treated alike, other columns are
kept, and no name of theirs can clash with a working column. Selected spans overlap neither a base span nor
each other (first start, then longest). Empty tables give no rows. Positions count code points, ends are
exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilerec.session import StepTables

KINDS = ("email", "ip", "card", "phone")

#: Base patterns. Possessive repeats and the look behind keep the matches and take time linear in the text;
#: the look ahead leaves out numbers of fewer than 13 digits, which fail the test in any case.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?=(?:[\x20-]?[0-9]){13})[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Further proposals: (kind, pattern).
PROPOSALS = (
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++ ?(?:@|\(at\)|\[at\]) ?[\p{L}\p{N}-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[\p{L}\p{N}-]++)++"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{13,19}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"),
    ("phone", r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{1,4}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])"),
    ("phone", r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
)

#: Words that announce personal data of a kind.
KEYWORDS = r"(?i)\b(?:tel|phone|call|fax|mobile|mail|e-mail|contact|card|visa|credit|ip|host|address)\b"

_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_SPAN = "array<struct<start:int,end:int,text:string,before:string,after:string>>"
_BLOCK = 256
_CONTEXT = 32


@dataclass(frozen=True)
class PiiOptions:
    """Size of the trees, and what a kind's threshold has to reach; all labelled spans of all texts are used."""

    trees: int = 12
    depth: int = 4
    precision: float = 0.95
    least_held_out: int = 5
    bins: int = 50
    seed: int = 7


def running_sums(lengths: Column) -> Column:
    """Sums of all elements before each element; blocks keep the appends short."""

    def within(values: Column, start: Column) -> Column:
        zero = F.struct(F.array().cast("array<int>").alias("out"), start.cast("int").alias("sum"))
        step = lambda acc, v: F.struct(F.concat(acc["out"], F.array(acc["sum"])).alias("out"), (acc["sum"] + v).alias("sum"))
        return F.aggregate(values, zero, step)["out"]

    count = F.ceil(F.size(lengths) / _BLOCK).cast("int")
    blocks = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(lengths, b * _BLOCK + 1, _BLOCK))).otherwise(
        F.array().cast("array<array<int>>")
    )
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, v: s + v))
    return F.flatten(F.zip_with(blocks, within(totals, F.lit(0)), within))


def with_spans(df: DataFrame, name: str, pattern: str, guard: Column) -> DataFrame:
    """Adds the matches of ``pattern`` in ``text`` with their positions and the text around them."""
    gaps, found, sizes, starts = f"{name}_gaps", f"{name}_found", f"{name}_sizes", f"{name}_starts"
    none = F.array().cast("array<string>")
    out = df.withColumns({
        found: F.when(guard, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none),
        gaps: F.when(guard, F.split("text", pattern, -1)).otherwise(none),
    })
    # Columns of their own: a lambda evaluates whole expressions again for every element.
    out = out.withColumn(sizes, F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda f, g: F.length(f) + F.length(g)))
    out = out.withColumn(starts, running_sums(F.col(sizes)))

    def span(f: Column, i: Column) -> Column:
        start = F.get(starts, i) + F.length(F.get(gaps, i))
        return F.struct(
            start.alias("start"), (start + F.length(f)).alias("end"), f.alias("text"), F.right(F.get(gaps, i), F.lit(_CONTEXT)).alias("before"),
            F.left(F.get(gaps, i + 1), F.lit(_CONTEXT)).alias("after"),
        )

    return out.withColumn(name, F.transform(found, span).cast(_SPAN)).drop(gaps, found, sizes, starts)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether 13 to 19 digits pass the Luhn sum; false for other lengths."""

    def value(i: Column) -> Column:
        d = F.substr(F.reverse(number), i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(number)), value), F.lit(0), lambda s, v: s + v)
    return F.when(F.length(number).between(13, 19), total % 10 == 0).otherwise(False)


def passes(kind: str, text: Column) -> Column:
    """The test of a base match."""
    if kind == "ip":
        return text.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return luhn(digits(text))
    if kind == "phone":
        return F.length(digits(text)).between(9, 15)
    return F.lit(True)


def _side(char: Column) -> Column:
    """The kind of a neighbouring character: none or blank 0, letter 1, digit 2, other 3."""
    return F.when(char.rlike(r"^\s*$"), 0).when(char.rlike(r"^\p{L}"), 1).when(char.rlike("^[0-9]"), 2).otherwise(3)


def features(kind: str, span: Column) -> Column:
    """Format and context of a span as numbers."""
    text, before, after = span["text"], span["before"], span["after"]
    number, count = digits(text), lambda p: F.length(text) - F.length(F.regexp_replace(text, p, ""))
    values = [
        F.lit(KINDS.index(kind)), F.length(text), F.length(number), count(r"[\x20-]"), count(r"\."), count("[()]"), count(r"\p{L}"), count("@"),
        passes("ip", text).cast("int"), luhn(number).cast("int"), text.startswith("+").cast("int"), F.size(F.split(text, r"[^0-9\p{L}]+", -1)),
        _side(F.right(before, F.lit(1))), _side(F.left(after, F.lit(1))), F.length(digits(before)), F.length(digits(after)),
        before.rlike(KEYWORDS).cast("int"),
    ]
    return F.array(*[v.cast("double") for v in values])


def _candidate(kind: str, span: Column, label: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"), label.cast("int").alias("label"),
        features(kind, span).alias("features"),
    )


def _labelled(kind: str, span: Column) -> Column:
    """A base match as a labelled span, with two spans of other bounds where it passes its test."""
    good = passes(kind, span["text"])
    more = F.regexp_extract(span["after"], r"^[^\p{L}\p{N}]?[\p{L}\p{N}]+", 0)
    # From the end, so that the pattern is tried at one place alone.
    most = F.reverse(F.regexp_replace(F.reverse(span["text"]), r"^[0-9\p{L}]++[^0-9\p{L}]*+", ""))
    less = F.when(most == "", F.left(span["text"], F.length(span["text"]) - 1)).otherwise(most)
    longer = F.struct(
        span["start"].alias("start"), span["end"].alias("end"), F.concat(span["text"], more).alias("text"), span["before"].alias("before"),
        F.substr(span["after"], F.length(more) + 1, F.lit(_CONTEXT)).alias("after"),
    )
    shorter = F.struct(
        span["start"].alias("start"), span["end"].alias("end"), less.alias("text"), span["before"].alias("before"),
        F.concat(F.substr(span["text"], F.length(less) + 1, F.lit(_CONTEXT)), span["after"]).alias("after"),
    )
    own = F.array(_candidate(kind, span, good))
    wrong = F.when(more != "", F.array(longer, shorter)).otherwise(F.array(shorter))
    return F.when(good, F.concat(own, F.transform(wrong, lambda w: _candidate(kind, w, F.lit(0))))).otherwise(own)


def search(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, base, labelled, proposed): each row as a struct with its base spans and candidates.

    ``base`` holds (kind, start, end) by kind and start.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = docs.select(F.struct(*columns).alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    numbers, at = F.col("text").rlike("[0-9]"), F.col("text").contains("@") | F.col("text").rlike(r"[(\[]at[)\]]")
    guards = {"email": at, "ip": numbers & F.col("text").contains("."), "card": numbers, "phone": numbers}
    for kind in KINDS:
        guard = guards[kind] & F.col("text").contains("+") if kind == "phone" else guards[kind]
        out = with_spans(out, f"b_{kind}", BASE[kind], guard)
    for i, (kind, pattern) in enumerate(PROPOSALS):
        out = with_spans(out, f"p_{i}", pattern, guards[kind])

    def bare(kind: str) -> Column:
        passing = F.filter(f"b_{kind}", lambda s: passes(kind, s["text"]))
        return F.transform(passing, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    def examples(kind: str) -> Column:
        return F.flatten(F.transform(f"b_{kind}", lambda s: _labelled(kind, s)))

    def scored(i: int, kind: str) -> Column:
        return F.transform(f"p_{i}", lambda s: _candidate(kind, s, F.lit(None)))

    base, labelled = [bare(k) for k in KINDS], [examples(k) for k in KINDS]
    proposed = [scored(i, k) for i, (k, _) in enumerate(PROPOSALS)]
    return out.select("row", F.concat(*base).alias("base"), F.concat(*labelled).alias("labelled"), F.concat(*proposed).alias("proposed"))


def _tree(node, values: Column) -> Column:
    """A fitted regression tree as an expression."""
    if not node.subtreeDepth():
        return F.lit(float(node.prediction()))
    split = node.split()
    test = values[split.featureIndex()] <= F.lit(float(split.threshold()))
    return F.when(test, _tree(node.leftChild(), values)).otherwise(_tree(node.rightChild(), values))


class Selector:
    """Fitted trees and the threshold of every kind; ``None`` where a kind selects nothing."""

    def __init__(self, model, thresholds: dict[str, float | None]):
        self.model, self.thresholds = model, thresholds

    def score(self, values: Column) -> Column:
        """Probability (0 to 1) of the positive class."""
        if self.model is None:
            return F.lit(0.0)
        margin = reduce(lambda a, b: a + b, [_tree(t._call_java("rootNode"), values) * float(w) for t, w in zip(self.model.trees, self.model.treeWeights)])
        return 1 / (1 + F.exp(-2 * margin))

    def selects(self, candidate: Column) -> Column:
        tests = [(candidate["kind"] == k) & (self.score(candidate["features"]) >= t) for k, t in self.thresholds.items() if t is not None]
        return reduce(lambda a, b: a | b, tests, F.lit(False))


def lowest_score(bins: list[tuple[int, int, int]], n_bins: int, precision: float, least: int) -> float | None:
    """Calibrated threshold from (bin, positives, all): pooled adjacent violators, then the first bin that is good enough."""
    pools: list[list[float]] = []
    for b, good, n in sorted(bins):
        pools.append([b, good, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] > pools[-1][1] * pools[-2][2]:
            _, good, n = pools.pop()
            pools[-1][1] += good
            pools[-1][2] += n
    fit = [p for p in pools if p[1] >= precision * p[2]]
    return fit[0][0] / n_bins if fit and sum(p[2] for p in fit) >= least else None


def fit(found: DataFrame, options: PiiOptions | None = None) -> Selector:
    """Trees and thresholds from the labelled spans of :func:`search`; without both classes nothing is selected."""
    options = options or PiiOptions()
    spans = found.select(F.explode("labelled").alias("s")).select("s.kind", "s.features", "s.label")
    steps = StepTables(found.sparkSession, "pii")
    # All spans, equal ones as one row with their number. A quarter of every number is held back; the hash rounds it up or down.
    counted = spans.groupBy("kind", "features", "label").agg(F.count("*").alias("n"))
    draw = F.pmod(F.xxhash64(F.to_json(F.struct("kind", "features", "label"))), F.lit(4))
    sample = steps.write(counted.withColumn("held", F.floor((F.col("n") + draw) / 4)), "spans")
    train = sample.where("n > held").select(
        array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"), (F.col("n") - F.col("held")).cast("double").alias("weight"))
    if train.select("label").distinct().count() < 2:
        return Selector(None, dict.fromkeys(KINDS))
    model = GBTClassifier(maxIter=options.trees, maxDepth=options.depth, stepSize=0.3, seed=options.seed, weightCol="weight").fit(train)
    fitted = Selector(model, dict.fromkeys(KINDS))
    cell = F.least(F.floor(fitted.score(F.col("features")) * options.bins), F.lit(options.bins - 1))
    counts = sample.where("held > 0").groupBy("kind", cell.alias("bin")).agg(
        F.sum(F.col("label") * F.col("held")).alias("good"), F.sum("held").alias("n"))
    held: dict[str, list] = {k: [] for k in KINDS}
    for r in counts.collect():  # at most bins x kinds rows
        held[r["kind"]].append((int(r["bin"]), int(r["good"]), int(r["n"])))
    fitted.thresholds = {k: lowest_score(held[k], options.bins, options.precision, options.least_held_out) for k in KINDS}
    steps.drop("spans")
    return fitted


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def select_spans(found: DataFrame, selector: Selector) -> DataFrame:
    """(row, base, spans): base spans, and these together with the selected ones, by kind and start."""
    span = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
    good = F.filter("proposed", lambda c: selector.selects(c))
    apart = found.withColumn("good", good).withColumn("good", F.filter("good", lambda c: ~F.exists("base", lambda b: _overlaps(b, c))))
    ordered = apart.withColumn("good", F.array_sort(F.transform("good", lambda c: F.struct(
        c["start"].alias("start"), (-c["end"]).alias("back"), c["end"].alias("end"), c["kind"].alias("kind")))))
    kind = "array<struct<kind:string,start:int,end:int>>"
    zero = F.struct(F.array().cast(kind).alias("out"), F.lit(0).alias("until"))
    keep = lambda acc, c: F.when(
        c["start"] >= acc["until"], F.struct(F.concat(acc["out"], F.array(span(c)).cast(kind)).alias("out"), c["end"].alias("until"))
    ).otherwise(acc)
    merged = ordered.withColumn("added", F.aggregate("good", zero, keep, lambda acc: acc["out"]))
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    rank = F.transform(F.concat("base", "added"), lambda s: F.struct(order[s["kind"]].alias("i"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return merged.withColumn("ranked", F.array_sort(rank)).select("row", "base", F.transform("ranked", span).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_spans(docs: DataFrame, text: str = "text", options: PiiOptions | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default all) of every row with ``base`` and ``spans``.

    The candidates are written once to the shared folder, so texts are read once for fitting and selecting.
    """
    kept = keep if keep is not None else docs.columns
    found = search(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, text])]), text)
    found = found.withColumn("row", F.struct(*[F.col("row")[c].alias(c) for c in kept]))
    found = StepTables(docs.sparkSession, "pii").write(found, "found")
    spans = select_spans(found, fit(found, options))
    return spans.select(*[F.col("row")[c].alias(c) for c in kept if c not in ("base", "spans")], "base", "spans")


def redact(docs: DataFrame, text: str = "text", options: PiiOptions | None = None) -> DataFrame:
    """All rows with the spans in ``text`` replaced by ``[kind]`` (null stays null), and ``spans``.

    Where base spans overlap, the first start wins; what a later one covers beyond it goes as well.
    """
    found = find_spans(docs, text, options)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    in_order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("until"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(body, acc["until"] + 1, F.greatest(s["start"] - acc["until"], F.lit(0)))
        mark = F.when(s["start"] >= acc["until"], F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise("")
        return F.struct(F.concat(acc["out"], F.array(F.concat(gap, mark))).alias("out"), F.greatest(acc["until"], s["end"]).alias("until"))

    end = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(body, acc["until"] + 1, F.length(body)))
    clean = F.when(F.col(f"`{text}`").isNotNull(), F.aggregate(in_order, zero, step, end))
    return found.withColumn(text, clean).drop("base")
