"""Column-level quality profile of loads: exact base aggregates and a classifier two-sample test.

The test trains logistic regressions over the cluster to tell a load from the one before. Rows
enter by coded features of each profiled column (null, malformed, length, kinds of characters,
value). Cross-fitting gives an unbiased AUC; leaving one column out at a time shows which column
carries the change. The test proposes the loads and columns that are reported; their exact
shares, read beside it, decide by how much a load must differ.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.session import cut, join_checked, small_rows

#: A whole file name.
FILE_PATTERN = r"[0-9]{8}_[a-z0-9]+\.(zarr|h5ad)"
FOLDS = 3
#: Standard errors from which a column that adds to the discrimination is proposed.
STRIKING = 3.0
#: Most protocols that are turned into one expression; more are joined.
MOST_PROTOCOLS = 1_000


def whole(column, pattern: str) -> F.Column:
    """Does the pattern match the whole value? Null for null."""
    return F.col(column).rlike(f"^(?:{pattern})\\z")


def barcode_fits(rows: list) -> F.Column:
    """Does ``barcode`` fit its protocol's pattern, or any pattern where the protocol is null? ``rows`` are the protocols'.

    A protocol without pattern fits nothing; a null barcode gives null.
    """
    fits = F.lit(False)
    if rows:
        fits = F.when(F.col("scrnaseq_protocol").isNull(), whole("barcode", "|".join(f"(?:{r['barcode_pattern']})" for r in rows)))
        for name in sorted({r["scrnaseq_protocol"] for r in rows}):
            own = "|".join(f"(?:{r['barcode_pattern']})" for r in rows if r["scrnaseq_protocol"] == name)
            fits = fits.when(F.col("scrnaseq_protocol") == name, whole("barcode", own))
        fits = fits.otherwise(F.lit(False))
    return F.when(F.col("barcode").isNotNull(), fits)


def checked(obs: DataFrame, protocols: DataFrame) -> DataFrame:
    """(load_no, row_index, barcode, barcode_ok, _source_file, _source_file_ok): the columns the profile needs.

    A few protocols become one expression; more are joined by name, each with its patterns.
    """
    known = protocols.where("scrnaseq_protocol is not null and barcode_pattern is not null").select("scrnaseq_protocol", "barcode_pattern")
    few = small_rows(known, MOST_PROTOCOLS)
    if few is not None:
        fits = barcode_fits(few)
    else:
        joined = F.concat_ws("|", F.collect_list(F.concat(F.lit("(?:"), "barcode_pattern", F.lit(")"))))
        obs = join_checked(obs.select("load_no", "_row_index", "barcode", "_source_file", "scrnaseq_protocol"), known.groupBy("scrnaseq_protocol").agg(joined.alias("_own")), "scrnaseq_protocol", "left")
        obs = obs.join(F.broadcast(known.agg(joined.alias("_any"))), F.lit(True))  # one row
        pattern = F.concat(F.lit("^(?:"), F.when(F.col("scrnaseq_protocol").isNull(), F.col("_any")).otherwise(F.col("_own")), F.lit(")\\z"))
        fits = F.when(F.col("barcode").isNotNull(), F.coalesce(F.regexp_like("barcode", pattern), F.lit(False)))
    return obs.select("load_no", F.col("_row_index").alias("row_index"), "barcode", fits.alias("barcode_ok"), "_source_file", whole("_source_file", FILE_PATTERN).alias("_source_file_ok"))


def base_aggregates(rows: DataFrame, columns=("barcode", "_source_file"), distinct: bool = True) -> DataFrame:
    """Per (load_no, column_name): rows, nulls, malformed, least and greatest value, top value's rows, distinct values.

    All exact. Value counts are combined before the shuffle. Null ``load_no`` is a load of its
    own here, but has no place in the order of loads. ``distinct`` False leaves out value counts
    of all columns but ``_source_file`` (null there).
    """
    result = None
    for c in columns:
        base = rows.groupBy("load_no").agg(
            F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count_if(~F.col(c + "_ok")).alias("malformed"), F.min(c).alias("least"), F.max(c).alias("greatest")
        )
        if distinct or c == "_source_file":
            counts = rows.where(F.col(c).isNotNull()).groupBy("load_no", c).agg(F.count(F.lit(1)).alias("k"))
            counts = counts.groupBy("load_no").agg(F.max("k").alias("top_rows"), F.count(F.lit(1)).alias("n_distinct"))
            base = base.alias("b").join(counts.alias("v"), F.col("b.load_no").eqNullSafe(F.col("v.load_no")), "left").select("b.*", F.coalesce("top_rows", F.lit(0)).alias("top_rows"), F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))
        else:
            base = base.withColumn("top_rows", F.lit(None).cast("long")).withColumn("n_distinct", F.lit(None).cast("long"))
        base = base.select(F.lit(c).alias("column_name"), "*")
        result = base if result is None else result.unionByName(base)
    return result


def frequent_values(rows: DataFrame, columns, least: float = 0.1) -> dict[str, list[str]]:
    """Values that make up at least ``least`` of a load: at most 1 / least of each load and column, exactly counted."""
    out = {}
    for c in columns:
        loads = rows.groupBy("load_no").agg(F.count(F.lit(1)).alias("all"))
        counts = rows.where(F.col(c).isNotNull()).groupBy("load_no", c).agg(F.count(F.lit(1)).alias("k"))
        many = counts.join(loads, "load_no").where(F.col("k") >= F.lit(least) * F.col("all")).select(F.col(c).alias("v")).distinct()
        out[c] = sorted(r["v"] for r in many.collect())
    return out


class Features:
    """Numbered features of a row: per column null or not, well formed or not, length, kinds of its characters, its alphabet, and its value.

    All of them are taken from the whole text, however long. Lengths below ``SHORT`` have a feature each,
    greater ones share hash slots, as kinds and alphabets do.

    Frequent values have a feature each, all others share hash slots whose number grows with the
    square root of the rows of a load. Null and the value features together part the rows of a
    column, each row having exactly one of them.
    """

    SHORT, LENGTHS, SHAPES, ALPHABETS = 32, 64, 64, 128

    def __init__(self, columns, frequent: dict[str, list[str]], rows_per_load: float):
        self.columns = list(columns)
        self.frequent = frequent
        self.slots = max(16, 2 ** math.ceil(math.log2(max(rows_per_load, 1)) / 2))
        self.base, at = [], 0
        for c in self.columns:
            self.base.append(at)
            at += 3 + self.LENGTHS + self.SHAPES + self.ALPHABETS + len(frequent.get(c, ())) + self.slots
        self.width = at

    def exact(self, j: int) -> np.ndarray:
        """Features that part the rows of column ``j``."""
        end = self.base[j + 1] if j + 1 < len(self.base) else self.width
        return np.concatenate(([self.base[j]], np.arange(self.base[j] + 3 + self.LENGTHS + self.SHAPES + self.ALPHABETS, end)))

    def coded(self) -> F.Column:
        """Array of the numbers of a row's features, -1 where a null value has none."""
        out = []
        for c, base in zip(self.columns, self.base):
            v = F.col(c)
            shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[0-9]+", "0"), "[a-z]+", "a"), "[A-Z]+", "A")
            alphabet = F.array_sort(F.array_distinct(F.split(v, "")))
            length = F.when(F.length(v) < self.SHORT, F.length(v)).otherwise(self.SHORT + F.pmod(F.xxhash64(F.length(v)), F.lit(self.LENGTHS - self.SHORT)))
            value = base + 3 + self.LENGTHS + self.SHAPES + self.ALPHABETS
            slot = F.lit(value + len(self.frequent.get(c, ()))) + F.pmod(F.xxhash64(v), F.lit(self.slots))
            for i, one in enumerate(self.frequent.get(c, ())):
                slot = F.when(v == one, F.lit(value + i)).otherwise(slot)
            known = (F.when(F.col(c + "_ok"), F.lit(base + 1)).otherwise(F.lit(base + 2)), base + 3 + length, base + 3 + self.LENGTHS + F.pmod(F.xxhash64(shape), F.lit(self.SHAPES)), base + 3 + self.LENGTHS + self.SHAPES + F.pmod(F.xxhash64(alphabet), F.lit(self.ALPHABETS)), slot)
            out += [F.when(v.isNull(), F.lit(base)).otherwise(known[0]), *(F.when(v.isNull(), F.lit(-1)).otherwise(k) for k in known[1:])]
        return F.array(*[x.cast("int") for x in out])

    def used(self, model: int) -> np.ndarray:
        """Positions in the array that a model sees: model 0 all, model 1 + j all but those of column j."""
        at = np.arange(5 * len(self.columns))
        return at if model == 0 else at[at // 5 != model - 1]


def _auc(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Weighted AUC with ties counted half."""
    _, at = np.unique(np.round(score, 9), return_inverse=True)
    one, zero = np.bincount(at, w * y), np.bincount(at, w * (1 - y))
    if not one.sum() or not zero.sum():
        return 0.5
    return float((one * (np.cumsum(zero) - zero / 2)).sum() / (one.sum() * zero.sum()))


def alone_auc(now: np.ndarray, then: np.ndarray) -> float:
    """Discrimination of the maximum-likelihood logistic regression on one categorical column, from the rows of each category.

    Its coefficients are log(now / then), so it orders the categories by that ratio. No category's
    share, nor that of any set of categories, differs by more than 2 * (AUC - 0.5).
    """
    both = now + then
    return _auc(np.tile(np.where(both > 0, now / np.maximum(both, 1), 0.5), 2), np.repeat([1.0, 0.0], len(now)), np.concatenate((now, then)).astype(float))


#: Score bins from which the AUC is read.
BINS = 8_192
_SUMS = "pair int, at int, a double, b double"


class Pairs:
    """Logistic regressions of each load against the one before, trained over the cluster.

    Every pass goes over the coded rows once, for all load pairs, models and folds together; tasks
    add up gradients and curvatures locally and only those sums are shuffled. Model 0 sees all
    columns, model 1 + j all but column j. A row of fold k is scored by the regressions trained
    without that fold.
    """

    def __init__(self, codes: DataFrame, features: Features, loads: list[int]):
        self.codes, self.features, self.loads = codes, features, loads
        self.models = 1 + len(features.columns)

    def _sums(self, work, *shared) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Per pair the two arrays that ``work`` adds up for (rows' features, fold, pair, is the later load)."""
        after = dict(zip(self.loads, self.loads[1:]))
        first = self.loads[0] if self.loads else None
        given = self.codes.sparkSession.sparkContext.broadcast(shared)

        def run(batches):
            total: dict[int, list[np.ndarray]] = {}
            for batch in batches:
                load, fold = (batch.column(k).to_numpy() for k in (0, 1))
                feats = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
                for one in np.unique(load).tolist():
                    mine = load == one
                    for pair, y in ((one, 1.0), (after.get(one), 0.0)):
                        if pair is None or (y and one == first):
                            continue
                        got = work(feats[mine], fold[mine], pair, y, *given.value)
                        if pair in total:
                            for have, new in zip(total[pair], got):
                                have += new
                        else:
                            total[pair] = list(got)
            for pair, (x, z) in total.items():
                at = np.flatnonzero((x != 0) | (z != 0))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), pair), pa.int32()), pa.array(at, pa.int32()), pa.array(x[at], pa.float64()), pa.array(z[at], pa.float64())], ["pair", "at", "a", "b"])

        rows = self.codes.mapInArrow(run, _SUMS).groupBy("pair", "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()
        pair, at, a, b = (rows.column(k).to_numpy() for k in range(4))
        out = {}
        for p in self.loads[1:]:
            mine = pair == p
            x, z = np.zeros(self.size), np.zeros(self.size)
            x[at[mine]], z[at[mine]] = a[mine], b[mine]
            out[p] = (x, z)
        return out

    def fit(self, steps: int = 6, ridge: float = 1.0) -> dict[int, np.ndarray]:
        """Coefficients (model, fold, feature, the last being the constant) of each pair.

        Starts from the features' own log odds, shared among the features that a row has, and takes
        accelerated steps along the gradient, scaled by curvature.
        """
        f, models = self.features, self.models
        shape = (models, FOLDS, f.width + 1)
        self.size = int(np.prod(shape))
        used = [f.used(m) for m in range(models)]

        def add(feats, fold, weights):
            """Sum of ``weights`` (model, fold, row) over the features of each row."""
            out = np.zeros(shape)
            for m, at in enumerate(used):
                where = np.where(feats[:, at] < 0, f.width, feats[:, at])
                for k in range(FOLDS):
                    out[m, k] = np.bincount(where.ravel(), np.repeat(weights[m, k], len(at)), f.width + 1)
                    out[m, k, f.width] = weights[m, k].sum()
            return out.ravel()

        def count(feats, fold, pair, y):
            w = np.broadcast_to((fold != np.arange(FOLDS)[:, None]).astype(float), (models, FOLDS, len(fold)))
            n = add(feats, fold, w)
            return n * y, n * (1 - y)

        counts = self._sums(count)
        beta, curve = {}, {}
        for p, (one, zero) in counts.items():
            one, zero = one.reshape(shape), zero.reshape(shape)
            prior = np.log((one[..., -1:] + 1) / (zero[..., -1:] + 1))
            b = np.log((one + ridge) / (zero + ridge * np.exp(-prior))) - prior
            n = np.array([len(u) for u in used], float)[:, None, None]
            b = np.where(one + zero > 0, b, 0.0) / n
            b[..., -1] = prior[..., 0]
            beta[p] = b
            share = one[..., -1:] / np.maximum(one[..., -1:] + zero[..., -1:], 1)
            curve[p] = (n + 1) * ((one + zero) * share * (1 - share)) + ridge  # bounds the curvature along any mix of a row's features
            curve[p][..., -1] = np.maximum(curve[p][..., -1], 1e-9)
        self.counts = counts

        def slope(feats, fold, pair, y, beta):
            z = scores(feats, beta[pair])
            r = (y - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) * (fold != np.arange(FOLDS)[:, None])
            got = add(feats, fold, r)
            return got, np.zeros_like(got)

        def scores(feats, b):
            safe = np.where(feats < 0, f.width, feats)
            z = np.empty((models, FOLDS, len(feats)))
            for m, at in enumerate(used):
                for k in range(FOLDS):
                    own = b[m, k].copy()
                    own[f.width] = 0.0
                    z[m, k] = own[safe[:, at]].sum(1) + b[m, k, f.width]
            return z

        self._scores = scores
        ahead, before = {p: b.copy() for p, b in beta.items()}, beta
        for step in range(steps):
            slopes = self._sums(slope, ahead)
            new = {p: ahead[p] + (slopes[p][0].reshape(shape) - ridge * np.concatenate((ahead[p][..., :-1], np.zeros(shape[:2] + (1,))), -1)) / curve[p] for p in ahead}
            ahead = {p: new[p] + step / (step + 3) * (new[p] - before[p]) for p in new}
            before = new
        self.beta = before
        return before

    def discrimination(self) -> dict[int, np.ndarray]:
        """Cross-fitted AUC of each model of each pair."""
        shape = (self.models, FOLDS, BINS)
        size, scores, models = int(np.prod(shape)), self._scores, self.models

        def place(feats, fold, pair, y, beta):
            z = scores(feats, beta[pair])
            out = np.zeros(shape)
            for m in range(models):
                own = z[m][fold, np.arange(len(fold))]
                at = np.clip(((np.clip(own, -15.999, 15.999) + 16) / 32 * BINS).astype(int), 0, BINS - 1)
                out[m] = np.bincount(fold * BINS + at, minlength=FOLDS * BINS).reshape(FOLDS, BINS)
            return out.ravel() * y, out.ravel() * (1 - y)

        self.size = size
        result = {}
        for p, (one, zero) in self._sums(place, self.beta).items():
            one, zero = one.reshape(shape), zero.reshape(shape)
            auc = np.full((self.models, FOLDS), 0.5)
            weight = (one + zero).sum(-1)
            for m in range(self.models):
                for k in range(FOLDS):
                    a, b = one[m, k], zero[m, k]
                    if a.sum() and b.sum():
                        auc[m, k] = (a * (np.cumsum(b) - b / 2)).sum() / (a.sum() * b.sum())
            result[p] = (auc * weight).sum(1) / np.maximum(weight.sum(1), 1)
        return result


_TEST = "load_no int, column_name string, auc double, z double, without double, drop double, alone double"
#: Most coefficients of a wave of load pairs that are trained together; bounds what is broadcast.
MOST_COEFFICIENTS = 4_000_000


def two_sample_test(rows: DataFrame, columns=("barcode", "_source_file")) -> DataFrame:
    """(load_no, column_name, auc, z, without, drop, alone) of each load against the preceding one.

    ``auc`` is cross-fitted over all columns, ``z`` its distance from 0.5 in standard errors under no
    change, ``without`` the AUC when the column is left out, ``drop`` = auc - without, and ``alone``
    the discrimination by the column's values alone (``alone_auc``). The first load has no rows
    here. Any number of columns is tested together; load pairs are trained in waves, so that what
    is broadcast stays bounded. One row per load and column reaches the driver.
    """
    known = rows.where("load_no is not null")
    sizes = {int(r[0]): r[1] for r in known.groupBy("load_no").agg(F.count(F.lit(1))).collect()}
    loads = sorted(sizes)
    spark = rows.sparkSession
    if len(loads) < 2:
        return spark.createDataFrame([], _TEST)
    features = Features(columns, frequent_values(known, columns[1:] if len(columns) > 1 and columns[0] == "barcode" else columns), sum(sizes.values()) / len(sizes))
    fold = F.pmod(F.xxhash64("row_index", "barcode", F.lit(11)), F.lit(FOLDS)).cast("int").alias("fold")
    codes = cut(known.select(F.col("load_no").cast("int"), fold, features.coded().alias("features")))
    out = []
    wave = max(1, MOST_COEFFICIENTS // ((1 + len(features.columns)) * FOLDS * (features.width + 1)))
    for k in range(0, len(loads) - 1, wave):
        own = loads[k : k + wave + 1]
        pairs = Pairs(codes.where(F.col("load_no").between(own[0], own[-1])), features, own)
        pairs.fit()
        counts = pairs.counts
        for p, auc in pairs.discrimination().items():
            n1, n0 = sizes[p], sizes[own[own.index(p) - 1]]
            z = (auc[0] - 0.5) / math.sqrt((n1 + n0 + 1) / (12 * n1 * n0))
            # every row stands in FOLDS - 1 of the trained parts
            one, zero = (x.reshape(1 + len(features.columns), FOLDS, -1)[0].sum(0) / (FOLDS - 1) for x in counts[p])
            for j, c in enumerate(features.columns):
                at = features.exact(j)
                out.append((p, c, float(auc[0]), float(z), float(auc[1 + j]), float(auc[0] - auc[1 + j]), alone_auc(one[at], zero[at])))
    return spark.createDataFrame(out, _TEST)


def load_profile(rows: DataFrame, distinct: bool = True) -> DataFrame:
    """Exact base aggregates of each load and column beside those of the preceding load and the test's figures."""
    base = base_aggregates(rows, distinct=distinct).withColumn("null_share", F.col("nulls") / F.col("n_rows")).withColumn("top_share", F.col("top_rows") / F.col("n_rows"))
    order = Window.partitionBy("column_name").orderBy("load_no")  # one row per load
    known = F.col("load_no").isNotNull()
    base = base.withColumn("null_share_before", F.when(known, F.lag(F.when(known, F.col("null_share"))).over(order))).withColumn("top_share_before", F.when(known, F.lag(F.when(known, F.col("top_share"))).over(order)))
    return base.join(two_sample_test(rows), ["load_no", "column_name"], "left")


def found(obs: DataFrame, protocols: DataFrame, null_change: float = 0.05, top_change: float = 0.15) -> DataFrame:
    """(load_no, column_name, measure, row_index): malformed values, and loads that differ from the one before.

    A load and column are examined if the classifiers tell the load from the one before by it: by the
    column's values alone beyond what ``null_change`` allows, or strikingly by all columns and
    less so without it. Two loads whose shares differ by d are told apart with an AUC of 0.5 + d / 2
    at least, so none is missed. Of what is proposed, the exact shares decide.
    """
    rows = checked(obs, protocols)
    bad = [rows.where(~F.col(c + "_ok")).select("load_no", F.lit(c).alias("column_name"), F.lit("pattern").alias("measure"), "row_index") for c in ("barcode", "_source_file")]
    profile = load_profile(rows, distinct=False)
    least = 0.5 + min(null_change, top_change) / 2 - 1e-9
    proposed = profile.where((F.col("alone") >= least) | ((F.col("z") >= STRIKING) & (F.col("drop") > 0)))
    tests = F.array(
        F.struct(F.lit("null_share").alias("measure"), (F.abs(F.col("null_share") - F.col("null_share_before")) > null_change).alias("hit")),
        F.struct(F.lit("top_share").alias("measure"), ((F.col("column_name") == "_source_file") & (F.abs(F.col("top_share") - F.col("top_share_before")) > top_change)).alias("hit")),
    )
    loads = proposed.select("load_no", "column_name", F.inline(tests)).where("hit").select("load_no", "column_name", "measure", F.lit(-1).cast("long").alias("row_index"))
    return bad[0].unionByName(bad[1]).unionByName(loads)
