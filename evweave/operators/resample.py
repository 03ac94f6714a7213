"""Minority oversampling (X9 SMOTE, X10 ADASYN, X11 synthetic weights).

Points with identical coordinates are collapsed to one point with a
multiplicity (a skew-safe ``groupBy``), so a heavily duplicated value can never
put a third of the rows into one group; neighbours of the distinct points come
from the exact k-d tree search of :mod:`evweave.operators.neighbours`, for any
number of features.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.prefix import hash_rank
from ..plans.small import with_scalars
from ..session import materialize
from .neighbours import nearest_points


def _coords(features: Sequence[str]):
    return F.array(*[F.col(c).cast("double") for c in features])


def collapse(df: DataFrame, features: Sequence[str], label: str | None = None) -> DataFrame:
    """Distinct coordinate vectors with multiplicity (and per-class counts)."""
    aggs = [F.count(F.lit(1)).alias("mult")]
    if label is not None:
        aggs += [F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("long").alias("n_pos"),
                 F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).cast("long").alias("n_neg")]
    return df.groupBy(_coords(features).alias("c")).agg(*aggs)


def _neighbour_array(nb: DataFrame) -> DataFrame:
    """(c, [neighbour coords repeated by take]) — at most k entries per query."""
    rep = nb.select("c", "dist", "nc", F.explode(F.sequence(F.lit(1), F.col("take").cast("int"))).alias("_t"))
    return rep.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("dist", "nc", "_t"))).alias("_nb")).select(
        "c", F.transform("_nb", lambda s: s["nc"]).alias("nbrs"))


CHUNK = 4096  # synthetic rows generated per task unit


def _synthesize(rows: DataFrame, nbrs: DataFrame, features: Sequence[str], id_col: str, seed: int,
                max_g: int | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """For each row with ``g`` > 0: g synthetic points x + u·(nn − x), nn drawn
    from its k neighbours (nearest first, equal distances by coordinates) and u ∈ [0, 1), both by md5. When a row may need more
    than ``CHUNK`` synthetic points (``max_g`` unknown or large), its work is
    cut into chunks that are spread over tasks first, so one hot row never
    generates everything in one task."""
    # a row without neighbours (the only minority point) is its own neighbour
    j = rows.withColumn("c", _coords(features)).join(nbrs, "c", "left").where(F.col("g") > 0)
    j = j.withColumn("nbrs", F.coalesce("nbrs", F.array("c")))
    if max_g is None or max_g > CHUNK:
        j = j.withColumn("_chunk", F.explode(F.sequence(F.lit(0), ((F.col("g") - 1) / CHUNK).cast("int"))))
        j = j.repartition(F.col(id_col), F.col("_chunk"))
        lo = F.col("_chunk") * CHUNK
        j = j.withColumn("_s", F.explode(F.sequence(lo, F.least(F.col("g"), lo + CHUNK) - 1)))
    else:
        j = j.withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    def draw(s: int):
        """A 32-bit number from the md5 of ``s:id:index``, the same in every engine."""
        key = F.concat_ws(":", F.lit(str(s)), F.col(id_col).cast("string"), F.col("_s").cast("string"))
        return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")

    pick = F.element_at("nbrs", (draw(seed) % F.size("nbrs") + 1).cast("int"))
    u = draw(seed + 1).cast("double") / F.lit(float(1 << 32))
    new = F.zip_with("c", pick, lambda a, b: a + u * (b - a))
    return j.select(F.col(id_col).alias("source_id"), F.col("_s").alias("synthetic_index"),
                    *[F.element_at(new, i + 1).alias(c) for i, c in enumerate(features)], *carry)


class Oversampler:
    """X9/X10/X11 over one training table. The neighbour tables (exact kNN,
    materialized once in the shared checkpoint folder) do not depend on the
    target ratio, so one instance serves every ratio and both methods."""

    def __init__(self, df: DataFrame, features: Sequence[str], label: str = "label", id_col: str = "event_key",
                 k: int = 5, minority: int = 1, weight: str | None = "weight", seed: int = 42):
        self.df, self.features, self.label, self.id_col = df, list(features), label, id_col
        self.k, self.minority, self.weight, self.seed = k, minority, weight, seed
        self.mino = df.where(F.col(label) == minority)
        cnt = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}  # one row per class
        self.n_min, self.n_maj = cnt.get(minority, 0), cnt.get(1 - minority, 0)
        self._nb = None
        self._r = None
        out_cols = [id_col, label] + self.features + ([weight] if weight else [])
        self.base = df.select(*out_cols).withColumn("synthetic", F.lit(False))

    def n_synthetic(self, ratio: float) -> int:
        """Rows to add so that minority/majority reaches ``ratio``."""
        return max(0, int(ratio * self.n_maj - self.n_min))

    def minority_neighbours(self) -> DataFrame:
        if self._nb is None:
            pts = collapse(self.mino, self.features)
            nb = nearest_points(pts.select("c"), pts, self.k, True)
            self._nb = materialize(_neighbour_array(nb))
        return self._nb

    def majority_share(self) -> DataFrame:
        """(c, r): share of majority points among the k nearest neighbours in
        the whole table (ADASYN's difficulty)."""
        if self._r is None:
            all_pts = collapse(self.df, self.features, self.label)
            maj_col = "n_neg" if self.minority == 1 else "n_pos"
            mpts = collapse(self.mino, self.features).select("c")
            nb = nearest_points(mpts, all_pts.select("c", "mult", F.col(maj_col).alias("n_maj"), F.col("mult").alias("n_all")),
                                self.k, True, extra=["n_maj", "n_all"])
            # on the query's own spot the query itself, a minority point, is left out
            others = F.when(F.col("dist") == 0, F.col("n_all") - 1).otherwise(F.col("n_all"))
            share = F.col("n_maj") / others
            self._r = materialize(nb.groupBy("c").agg(
                (F.sum(F.col("take") * share) / F.lit(float(self.k))).alias("r")))
        return self._r

    def _smote_count(self, n_syn: int):
        """SMOTE's synthetic rows of a minority row, from its place ``_r`` in hash order."""
        per, extra = divmod(n_syn, self.n_min)
        return F.lit(per) + F.when(F.col("_r") <= extra, 1).otherwise(0)

    @staticmethod
    def _adasyn_count(n_syn: int):
        """ADASYN's synthetic rows of a minority row, from its share ``r`` of the sum ``_rt``."""
        return F.when(F.col("_rt") > 0, F.rint(F.col("r") / F.col("_rt") * F.lit(float(n_syn)))).otherwise(0).cast("int")

    def _ranked(self) -> DataFrame:
        return hash_rank(self.mino, [], self.seed, [self.id_col], out="_r").drop("_h")

    def _shared(self) -> DataFrame:
        rows = self.mino.withColumn("c", _coords(self.features)).join(self.majority_share(), "c", "left").fillna({"r": 0.0})
        return with_scalars(rows, rows.agg(F.sum("r").alias("_rt")))

    def smote(self, ratio: float = 0.5) -> DataFrame:
        """X9 + X11: n_syn synthetic rows spread evenly over the minority rows
        (⌊n_syn/n_min⌋ each, one more for the first n_syn mod n_min in hash
        order — exact total); they carry the mean training weight and
        ``synthetic = true``. Original rows are returned too."""
        n_syn = self.n_synthetic(ratio)
        if n_syn == 0 or self.n_min == 0:
            return self.base
        rows = self._ranked().withColumn("g", self._smote_count(n_syn))
        return self._finish(_synthesize(rows, self.minority_neighbours(), self.features, self.id_col, self.seed,
                                        max_g=n_syn // self.n_min + 1))

    def adasyn(self, ratio: float = 0.5) -> DataFrame:
        """Row i gets g_i = rint(r̂_i·n_syn) synthetic rows with
        r̂ = r/Σr, r_i the majority share among its k nearest neighbours."""
        n_syn = self.n_synthetic(ratio)
        if n_syn == 0 or self.n_min == 0:
            return self.base
        rows = self._shared().withColumn("g", self._adasyn_count(n_syn)).drop("c", "r", "_rt")
        return self._finish(_synthesize(rows, self.minority_neighbours(), self.features, self.id_col, self.seed))

    def synthetic_levels(self, method: str, ratios: Sequence[float]) -> DataFrame:
        """The synthetic rows of all ``ratios`` (ascending) at once, with ``level``: the first ratio, by place, that
        has the row. A row's draws do not depend on the ratio and its count does not fall with it, so
        the rows up to a level are what ``smote`` or ``adasyn`` adds at that ratio."""
        if list(ratios) != sorted(ratios):
            raise ValueError("ratios must ascend")
        wanted = [self.n_synthetic(r) for r in ratios]
        if not wanted or wanted[-1] == 0 or self.n_min == 0:
            return self.base.limit(0).withColumn("level", F.lit(0))
        if method == "smote":
            rows = self._ranked()
            counts, most = [self._smote_count(n) for n in wanted], wanted[-1] // self.n_min + 1
        else:
            rows = self._shared()
            counts, most = [self._adasyn_count(n) for n in wanted], None
        rows = rows.withColumn("_gs", F.array(*[c.cast("int") for c in counts])).withColumn("g", F.element_at("_gs", -1))
        syn = _synthesize(rows.drop("c", "r", "_rt"), self.minority_neighbours(), self.features, self.id_col, self.seed, most, ["_gs"])
        level = F.size(F.filter("_gs", lambda g: g <= F.col("synthetic_index")))
        return self._finish(syn.withColumn("level", level).drop("_gs"), ["level"]).where("synthetic")

    def _finish(self, syn: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
        id_col = self.id_col
        syn = syn.withColumn(id_col, F.concat_ws("#", F.col("source_id").cast("string"),
                                                 F.col("synthetic_index").cast("string")))
        syn = syn.drop("source_id", "synthetic_index").withColumn(self.label, F.lit(self.minority)) \
            .withColumn("synthetic", F.lit(True))
        if self.weight:
            mw = self.df.agg(F.avg(self.weight).alias(self.weight))  # X11: one row
            syn = with_scalars(syn, mw)
        if extra:
            return syn.select(*self.base.columns, *extra)
        return self.base.unionByName(syn.select(*self.base.columns))


def smote(df: DataFrame, features: Sequence[str], ratio: float = 0.5, **kw) -> DataFrame:
    """SMOTE up to minority/majority = ``ratio``."""
    return Oversampler(df, features, **kw).smote(ratio)


def adasyn(df: DataFrame, features: Sequence[str], ratio: float = 0.5, **kw) -> DataFrame:
    """ADASYN up to minority/majority = ``ratio``."""
    return Oversampler(df, features, **kw).adasyn(ratio)
