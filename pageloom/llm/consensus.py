"""Problem 4: consensus from several annotators' labels.

A competence-and-spamming mixture: each label is either the true one, with the
annotator's competence as probability, or drawn from the annotator's own guess
distribution. Expectation-maximisation gives the probability of each label of
each item and both parameters of each annotator; it ends when no parameter moves
by more than `tol`.

Labels outside the classes, nulls and rows without item or annotator count as
not given; of several labels of one annotator on one item the latest counts. An
item without labels has no consensus. An item has at most one label of each
annotator, so its row holds no more labels than there are annotators. Ties fall
to the smaller label. Empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import durable

CLASSES = (0, 1, 2)
#: Pairs of criterion and annotator whose parameters are kept in the driver and broadcast; more are kept in tables.
FEW = 100_000


def latest_labels(rows: DataFrame, item: list[str], annotator: str, criteria: list[str], order: list[str], classes: tuple[int, ...] = CLASSES) -> DataFrame:
    """(item columns, annotator, criterion, label): usable labels, the latest row of an annotator on an item only."""
    key = [*item, annotator]
    last = rows.where(" and ".join(f"{c} is not null" for c in key)).groupBy(*key).agg(F.max(F.struct(*order, *criteria)).alias("r"))
    long = last.select(*item, F.col(annotator).alias("annotator"), F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(f"r.{c}").cast("int").alias("label")) for c in criteria])).alias("x"))
    return long.select(*item, "annotator", "x.criterion", "x.label").where(F.col("label").isin(*classes))


def per_item(labels: DataFrame, item: list[str], classes: tuple[int, ...] = CLASSES) -> DataFrame:
    """(criterion, item columns, labels): one row per item and criterion, labels as array<struct<annotator, k>>, k the label's place among the classes."""
    k = F.array_position(F.array(*map(F.lit, classes)), F.col("label")).cast("int") - 1
    return labels.groupBy("criterion", *item).agg(F.array_sort(F.collect_list(F.struct("annotator", k.alias("k")))).alias("labels"))


def _probabilities(d: DataFrame, n: int) -> DataFrame:
    """d with p0, p1, ...: the classes' probabilities from s0, s1, ..., their log-probabilities up to a constant."""
    top = F.greatest(*[F.col(f"s{t}") for t in range(n)])
    total = sum((F.exp(F.col(f"s{t}") - top) for t in range(n)), F.lit(0.0))
    return d.select("*", *[(F.exp(F.col(f"s{t}") - top) / total).alias(f"p{t}") for t in range(n)])


def _log_likelihoods(n: int) -> list[Column]:
    """Of a label k under each class, from c and g."""
    return [F.log(F.when(F.col("k") == t, F.col("c")).otherwise(0.0) + (1 - F.col("c")) * F.col("g")).alias(f"l{t}") for t in range(n)]


def _posteriors(items: DataFrame, item: list[str], params: DataFrame, prior: DataFrame | None, n: int, few: bool) -> DataFrame:
    """(criterion, item columns, labels, s0, s1, ..., p0, p1, ...).

    few: params holds one row per criterion, with prior and _l0, _l1, ... as arrays in
    which the labels' a and k are the place; the items are then not shuffled.
    Otherwise labels and parameters meet by shuffle.
    """
    if few:
        d = items.join(F.broadcast(params), "criterion")

        def total(t: int) -> Column:
            return F.aggregate("labels", F.get("prior", F.lit(t)), lambda acc, x: acc + F.get(f"_l{t}", x["a"] * n + x["k"])).alias(f"s{t}")

        return _probabilities(d.select("criterion", *item, "labels", *[total(t) for t in range(n)]), n)
    known = params.select("*", *_log_likelihoods(n))
    x = items.select("criterion", *item, F.explode("labels").alias("x")).select("criterion", *item, "x.annotator", "x.k").join(known, ["criterion", "annotator", "k"])
    d = x.groupBy("criterion", *item).agg(F.array_sort(F.collect_list(F.struct("annotator", "k"))).alias("labels"), *[F.sum(f"l{t}").alias(f"l{t}") for t in range(n)])
    d = d.join(F.broadcast(prior), "criterion").select("criterion", *item, "labels", *[(F.get("prior", F.lit(t)) + F.col(f"l{t}")).alias(f"s{t}") for t in range(n)])
    return _probabilities(d, n)


def _expected(post: DataFrame, n: int) -> DataFrame:
    """(criterion, annotator, k, n, m0, m1, ...): labels given, and the expected counts of the classes behind them."""
    p = [f"p{t}" for t in range(n)]
    x = post.select("criterion", *p, F.explode("labels").alias("x")).select("criterion", *p, "x.annotator", "x.k")
    return x.groupBy("criterion", "annotator", "k").agg(F.count("*").alias("n"), *[F.sum(p[t]).alias(f"m{t}") for t in range(n)])


def _maximise(sums: list[dict], now: dict[tuple, tuple[float, float]], n: int, smoothing: float) -> tuple[dict[tuple, tuple[float, float]], list[tuple]]:
    """Parameters by (criterion, annotator, k), and the classes' log-frequencies, from the expected counts of a round with the parameters `now`."""
    given, kept, mass = {}, {}, {}
    for r in sums:
        key = r["criterion"], r["annotator"], r["k"]
        c, g = now[key]
        given[key], kept[key] = r["n"], r[f"m{r['k']}"] * c / (c + (1 - c) * g)
        for t in range(n):
            mass[r["criterion"], t] = mass.get((r["criterion"], t), 0.0) + r[f"m{t}"]
    new = {}
    for w in dict.fromkeys(k[:2] for k in now):
        all_n, all_kept = (sum(x.get((*w, t), 0) for t in range(n)) for x in (given, kept))
        for t in range(n):
            spam = given.get((*w, t), 0) - kept.get((*w, t), 0)
            new[(*w, t)] = float((all_kept + 0.5 * smoothing) / (all_n + smoothing)), float((spam + smoothing / n) / (all_n - all_kept + smoothing))
    prior = []
    for c in sorted({k[0] for k in now}):
        total = sum(mass.get((c, t), 0.0) for t in range(n))
        prior.append((c, [math.log((mass.get((c, t), 0.0) + 1) / (total + n)) for t in range(n)]))
    return new, prior


def _ahead(zero: dict, one: dict, two: dict, n: int, least: float = 1e-6) -> dict:
    """Parameters extrapolated from three successive ones (squared extrapolation of EM), kept within their bounds."""
    r = {k: [y - x for x, y in zip(zero[k], one[k])] for k in zero}
    v = {k: [z - 2 * y + x for x, y, z in zip(zero[k], one[k], two[k])] for k in zero}
    size = lambda d: math.sqrt(sum(x * x for p in d.values() for x in p))
    if size(v) == 0:
        return two
    step = max(1.0, size(r) / size(v))
    out = {k: [min(1 - least, max(least, x + 2 * step * a + step * step * b)) for x, a, b in zip(zero[k], r[k], v[k])] for k in zero}
    sums = {k[:2]: sum(out[(*k[:2], t)][1] for t in range(n)) for k in out}
    return {k: (c, g / sums[k[:2]]) for k, (c, g) in out.items()}


def _maximised(counts: DataFrame, params: DataFrame, n: int, smoothing: float) -> tuple[DataFrame, DataFrame]:
    """The same on tables."""
    by_who = Window.partitionBy("criterion", "annotator")
    grid = params.join(counts, ["criterion", "annotator", "k"], "left").fillna(0)
    own = sum((F.when(F.col("k") == t, F.col(f"m{t}")).otherwise(0.0) for t in range(n)), F.lit(0.0))
    grid = grid.withColumn("kept", own * F.col("c") / (F.col("c") + (1 - F.col("c")) * F.col("g")))
    spam = F.col("n") - F.col("kept")
    new = grid.select(
        "criterion", "annotator", "k", ((F.sum("kept").over(by_who) + 0.5 * smoothing) / (F.sum("n").over(by_who) + smoothing)).alias("c"),
        ((spam + smoothing / n) / (F.sum(spam).over(by_who) + smoothing)).alias("g"),
    )
    mass = counts.groupBy("criterion").agg(*[F.sum(f"m{t}").alias(f"m{t}") for t in range(n)])
    total = sum((F.col(f"m{t}") for t in range(n)), F.lit(0.0))
    return new, mass.select("criterion", F.array(*[F.log((F.col(f"m{t}") + 1) / (total + n)) for t in range(n)]).alias("prior"))


def fit(labels: DataFrame, item: list[str], classes: tuple[int, ...] = CLASSES, rounds: int = 500, tol: float = 2e-3, smoothing: float = 1.0, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """(items with class probabilities, parameters) after expectation-maximisation.

    items: criterion, item columns, labels, s0, ..., p0, ..., see _posteriors();
    parameters: criterion, annotator, k, c (competence), g (probability of the label
    when guessing). Up to `few` pairs of criterion and annotator the parameters are
    kept in the driver and sent out, more are kept in tables: the steps and the rule
    to stop are the same. Raises if `rounds` do not suffice.
    """
    n, spark = len(classes), labels.sparkSession
    items = durable(per_item(labels, item, classes))
    who = items.select("criterion", F.explode("labels.annotator").alias("annotator")).distinct()
    pairs = [(r["criterion"], r["annotator"]) for r in who.limit(few + 1).collect()]
    small = len(pairs) <= few
    flat, moved = [math.log(1.0 / n)] * n, 0.0
    if small:
        criteria, names = sorted({c for c, _ in pairs}), {a: i for i, a in enumerate(sorted({a for _, a in pairs}))}
        places = F.broadcast(spark.createDataFrame(list(names.items()), "annotator string, a int"))
        placed = items.select("criterion", *item, F.explode("labels").alias("x")).select("criterion", *item, "x.*").join(places, "annotator")
        items = durable(placed.groupBy("criterion", *item).agg(F.array_sort(F.collect_list(F.struct("annotator", "a", "k"))).alias("labels")))
        # every annotator has parameters for every criterion, so that their places are the same
        now, prior = {(c, a, t): (0.7, 1.0 / n) for c in criteria for a in names for t in range(n)}, [(c, flat) for c in criteria]

        def sent(now: dict, prior: list[tuple]) -> DataFrame:
            lik = {c: [[math.log((k == t) * x + (1 - x) * g) for (d, _, k), (x, g) in now.items() if d == c] for t in range(n)] for c in criteria}
            return spark.createDataFrame([(c, p, *lik[c]) for c, p in prior], "criterion string, prior array<double>, " + ", ".join(f"_l{t} array<double>" for t in range(n)))

        def step(now: dict, prior: list[tuple]) -> tuple[dict, list[tuple]]:
            return _maximise([r.asDict() for r in _expected(_posteriors(items, item, sent(now, prior), None, n, True), n).collect()], now, n, smoothing)

        before: list[dict] = []
        for _ in range(rounds):
            new, prior = step(now, prior)
            moved = max((abs(x - y) for k in new for x, y in zip(new[k], now[k])), default=0.0)
            if moved < tol:
                params = spark.createDataFrame([(*k, *v) for k, v in new.items()], "criterion string, annotator string, k int, c double, g double")
                return _posteriors(items, item, sent(new, prior), None, n, True), params
            before, now = [*before, now], new
            if len(before) == 2:  # two rounds show where the parameters are heading: go there at once
                now, before = _ahead(*before, new, n), []
    else:
        params = durable(who.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("c", F.lit(0.7)).withColumn("g", F.lit(1.0 / n)))
        prior = who.select("criterion").distinct().withColumn("prior", F.array(*map(F.lit, flat)))
        for _ in range(rounds):
            new, pri = map(durable, _maximised(durable(_expected(_posteriors(items, item, params, prior, n, False), n)), params, n, smoothing))
            both = new.join(params.select("criterion", "annotator", "k", F.col("c").alias("c0"), F.col("g").alias("g0")), ["criterion", "annotator", "k"])
            moved = both.agg(F.max(F.greatest(F.abs(F.col("c") - F.col("c0")), F.abs(F.col("g") - F.col("g0"))))).first()[0] or 0.0
            params, prior = new, pri
            if moved < tol:
                return _posteriors(items, item, params, prior, n, False), params
    raise RuntimeError(f"parameters still move by {moved} after {rounds} rounds")


def consensus(posteriors: DataFrame, item: list[str], classes: tuple[int, ...] = CLASSES) -> DataFrame:
    """(criterion, item columns, label, probability, agreement, annotators): one row per item and criterion.

    agreement: share of agreeing pairs among the item's labels, null for one label.
    """
    n = F.size("labels")
    counts = [F.size(F.array_remove(F.transform("labels.k", lambda k: k == t), F.lit(False))) for t in range(len(classes))]
    pairs = sum((c * (c - 1) for c in counts), F.lit(0))
    best = F.greatest(*[F.col(f"p{t}") for t in range(len(classes))])
    label = F.coalesce(*[F.when(F.col(f"p{t}") == best, F.lit(c)) for t, c in enumerate(classes)])
    return posteriors.select("criterion", *item, label.alias("label"), best.alias("probability"), F.when(n > 1, pairs / (n * (n - 1))).alias("agreement"), n.alias("annotators"))


def chance_corrected_agreement(labels: DataFrame, item: list[str], classes: tuple[int, ...] = CLASSES) -> DataFrame:
    """(criterion, items, labels, alpha): agreement of all annotators beyond chance on each criterion, Krippendorff's alpha for names; items with one label do not count.

    1 is full agreement, 0 what chance gives; null where all labels are the same.
    """
    per = labels.groupBy("criterion", *item).agg(*[F.sum((F.col("label") == t).cast("bigint")).alias(f"n{t}") for t in classes], F.count("*").alias("m")).where("m > 1")
    differ = sum((F.col(f"n{t}") * (F.col("m") - F.col(f"n{t}")) for t in classes), F.lit(0))
    g = per.groupBy("criterion").agg(F.count("*").alias("items"), F.sum("m").alias("labels"), F.sum(differ / (F.col("m") - 1)).alias("_do"), *[F.sum(f"n{t}").alias(f"n{t}") for t in classes])
    chance = sum((F.col(f"n{t}") * (F.col("labels") - F.col(f"n{t}")) for t in classes), F.lit(0)) / (F.col("labels") - 1)
    return g.select("criterion", "items", "labels", (1 - F.col("_do") / F.nullif(chance, F.lit(0.0))).alias("alpha"))


def annotator_report(posteriors: DataFrame, params: DataFrame, classes: tuple[int, ...] = CLASSES) -> DataFrame:
    """(criterion, annotator, labels, competence, guess_label, guess_share, kappa, crossed_share).

    guess_label and guess_share: the label the annotator mostly draws when not
    truthful, and how mostly; kappa: agreement beyond chance with the items'
    labels; crossed_share: of the labels 1 and 2 on items that are 1 or 2, those
    interchanged. The items' probabilities are taken without the annotator's own label.
    """
    n = len(classes)
    d = posteriors.select("criterion", *[f"s{t}" for t in range(n)], F.explode("labels").alias("x")).select("criterion", "x.annotator", "x.k", *[f"s{t}" for t in range(n)])
    known = params.select("criterion", "annotator", "k", *_log_likelihoods(n))
    d = d.join(known, ["criterion", "annotator", "k"]).select("criterion", "annotator", "k", *[(F.col(f"s{t}") - F.col(f"l{t}")).alias(f"s{t}") for t in range(n)])
    d = _probabilities(d, n)
    cells = d.groupBy("criterion", "annotator", "k").agg(F.count("*").alias("n"), *[F.sum(f"p{t}").alias(f"m{t}") for t in range(n)])
    own = Window.partitionBy("criterion", "annotator")
    all_n = F.sum("n").over(own)
    hit = sum((F.when(F.col("k") == t, F.col(f"m{t}")).otherwise(0.0) for t in range(n)), F.lit(0.0)) / all_n
    chance = sum((F.when(F.col("k") == t, F.col("n") / all_n * F.sum(f"m{t}").over(own) / all_n).otherwise(0.0) for t in range(n)), F.lit(0.0))
    one, two = (F.lit(classes.index(v) if v in classes else -1) for v in (1, 2))
    of = lambda k: sum((F.when(k == t, F.col(f"m{t}")).otherwise(0.0) for t in range(n)), F.lit(0.0))
    crossed, straight = F.when(F.col("k") == one, of(two)).when(F.col("k") == two, of(one)).otherwise(0.0), F.when(F.col("k").isin(one, two), of(F.col("k"))).otherwise(0.0)
    per = cells.select("*", hit.alias("hit"), chance.alias("chance"), crossed.alias("crossed"), straight.alias("straight")).groupBy("criterion", "annotator").agg(
        F.sum("n").alias("labels"), (F.sum("crossed") / F.nullif(F.sum("crossed") + F.sum("straight"), F.lit(0.0))).alias("crossed_share"),
        ((F.sum("hit") - F.sum("chance")) / F.nullif(1 - F.sum("chance"), F.lit(0.0))).alias("kappa"),
    )
    top = params.groupBy("criterion", "annotator").agg(F.max("c").alias("competence"), F.max(F.struct("g", (-F.col("k")).alias("k"))).alias("_g"))
    label = F.get(F.array(*map(F.lit, classes)), -F.col("_g.k"))
    return per.join(top, ["criterion", "annotator"]).select("criterion", "annotator", "labels", "competence", label.alias("guess_label"), F.col("_g.g").alias("guess_share"), "kappa", "crossed_share")


def faults(report: DataFrame, competent: float = 0.4, constant: float = 0.8, swapped: float = 0.7) -> DataFrame:
    """(annotator, fault): annotators whose labels are mostly not truthful, over all criteria weighted by labels.

    What an annotator of little competence draws from tells the fault: one label
    nearly always is constant; of the others, those that cross 1 and 2 are swapped,
    and the rest random.
    """
    w = lambda c: F.sum(F.col(c) * F.col("labels")) / F.sum("labels")
    g = report.groupBy("annotator").agg(w("competence").alias("c"), w("guess_share").alias("g"), w("crossed_share").alias("crossed"))
    kind = F.when(F.col("g") >= constant, "constant").when(F.col("crossed") >= swapped, "swapped").otherwise("random")
    return g.where(F.col("c") < competent).select("annotator", kind.alias("fault"))
