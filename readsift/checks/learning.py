"""Encoding, learners, evaluation, sweeps and inspection on the experiment frame."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import functions as F

from readsift import config
from readsift.checks.frames import INDEXED_SQL, frame
from readsift.checks.registering import Book
from readsift.checks.warehouse_sql import PROBES, context_ctes, warehouse_query
from readsift.config import Experiment, FeatureSpec
from readsift.learners import fit, learner
from readsift.learners.base import scored_columns
from readsift.learners.calibration import fit_isotonic
from readsift.learners.spark_ml import tree_nodes
from readsift.operators import duplicates, folds, metrics
from readsift.operators.encode import categories, fit_encoding, nonzero_entries, one_hot_long, standardised
from readsift.operators.profile import vocabulary
from readsift.plans import experiment, run
from readsift.plans.frame import experiment_frame
from readsift.session import stage
from readsift.sources.derived import SINCE, derived_warehouse

BOOK = Book()
query = BOOK.query

SPEC = FeatureSpec()
_CATS, _NUMS, _BINS = config.CATEGORICAL_COLUMNS, config.NUMERICAL_COLUMNS, config.BINARY_COLUMNS

_FRAME = f"frame AS ({INDEXED_SQL}), size AS (SELECT count(*) AS n FROM frame)"
_TRAIN = "CAST(floor(CAST(0.8 AS DOUBLE) * n) AS BIGINT)"


def _sql(select: str, *ctes: str) -> str:
    return warehouse_query(select, PROBES["labelled"], context_ctes("labelled"), _FRAME, *ctes)


_LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT row_idx, {i} AS i, '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM frame" for i, c in enumerate(_CATS)
) + ")"
_VOCABULARY = (
    'vocabulary AS (SELECT i, "column", value, row_number() OVER (ORDER BY i, TRY_CAST(value AS DOUBLE), value) - 1 AS slot '
    'FROM (SELECT DISTINCT i, "column", value FROM long))'
)


@query(_sql('SELECT row_idx, long."column", slot FROM long JOIN vocabulary USING (i, value)', _LONG, _VOCABULARY))
def one_hot_slots(spark, sf_dir):
    return one_hot_long(frame(spark, sf_dir), _CATS, "row_idx")


def _scaled_sql(where: str = "TRUE") -> str:
    """CTE: numeric columns by the moments of the rows that satisfy ``where``."""
    parts = ", ".join(
        f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in _NUMS
    )
    scaled = ", ".join(f"({c} - m_{c}) / s_{c} AS z_{c}" for c in _NUMS)
    return (
        f"moments AS (SELECT {parts} FROM frame, size WHERE {where}), "
        f"scaled AS (SELECT frame.*, {scaled} FROM frame, moments)"
    )


@query(
    _sql("SELECT row_idx, " + ", ".join(f"z_{c} AS {c}" for c in _NUMS) + " FROM scaled", _scaled_sql()),
    rounded=_NUMS,
)
def standardised_numbers(spark, sf_dir):
    return standardised(frame(spark, sf_dir).select("row_idx", *_NUMS), _NUMS)


def _positions_sql() -> str:
    rest = " UNION ALL ".join(
        f"SELECT row_idx, w + {i} AS position, {x} AS value FROM scaled, width"
        for i, x in enumerate([f"z_{c}" for c in _NUMS] + [f"CAST({c} AS DOUBLE)" for c in _BINS])
    )
    return (
        "SELECT row_idx, CAST(position AS INT) AS position, value FROM (SELECT row_idx, slot AS position, "
        f"CAST(1 AS DOUBLE) AS value FROM long JOIN vocabulary USING (i, value) UNION ALL {rest}) WHERE value <> 0"
    )


@query(
    _sql(_positions_sql(), _LONG, _VOCABULARY, _scaled_sql(), "width AS (SELECT count(*) AS w FROM vocabulary)"),
    rounded=('value',),
)
def encoded_vectors(spark, sf_dir):
    """Non-zero entries of the assembled vector: one-hot, numerics, passed through."""
    df = frame(spark, sf_dir)
    return nonzero_entries(fit_encoding(df, SPEC).transform(df), "row_idx")


@query(_sql(f"SELECT CAST(count(*) + {len(_NUMS) + len(_BINS)} AS BIGINT) AS width FROM vocabulary", _LONG, _VOCABULARY))
def encoded_width(spark, sf_dir):
    slots = vocabulary(frame(spark, sf_dir), _CATS)
    return slots.agg((F.count(F.lit(1)) + len(SPEC.numerical) + len(SPEC.passthrough)).alias("width"))


@dataclass(frozen=True)
class _BetweenNeighbours:
    """Rule in place of a learner: accept a read between its neighbours."""

    name: str = "between"

    def fit(self, encoded, encoding):
        return self

    def prefix_scorers(self, encoded, encoding, stops, index):
        yield stops, self.transform

    def transform(self, df):
        inside = F.col("READ_VALUE").between(F.col("PREV_READ"), F.col("NEXT_READ_VALUE"))
        answer = inside.cast("int")
        return df.withColumns({"prediction": answer, "p1": answer.cast("double"), "score": answer.cast("double")})


_RULE = "CASE WHEN READ_VALUE BETWEEN PREV_READ AND NEXT_READ_VALUE THEN 1 ELSE 0 END"
_HIT = f"avg(CASE WHEN {_RULE} = Status THEN 1.0 ELSE 0.0 END)"
_ORDERED = Experiment()
_SHUFFLED = replace(_ORDERED, time_series=False)


def _split(spark, sf_dir, setting=_ORDERED):
    """The whole frame, its size, and the train and test rows of the hold-out."""
    df = frame(spark, sf_dir)
    n = df.count()
    return (df, n, *experiment.holdout(df, n, setting))


@query(
    _sql(
        f"SELECT CAST(i AS INT) AS fold, role AS split, {_HIT} AS value FROM "
        "(SELECT i, frame.*, CASE WHEN row_idx < n - (10 - i) * (n // 11) THEN 'train' ELSE 'test' END AS role "
        "FROM frame, size, range(10) g(i) WHERE row_idx < n - (9 - i) * (n // 11)) GROUP BY 1, 2"
    ),
    rounded=('value',),
)
def cross_validation_of_rule(spark, sf_dir):
    """Expanding-window scores of a fixed rule, fold by fold."""
    df = frame(spark, sf_dir)
    return experiment.prefix_validate(df, experiment.expanding_parts(df.count(), 10), _BetweenNeighbours(), SPEC).select("fold", "split", "value")


_SEEDED = "row_number() OVER (PARTITION BY Status ORDER BY md5(concat('0', ':', CAST(row_idx AS VARCHAR))), row_idx) - 1"


@query(
    _sql(
        f"SELECT row_idx, CAST(({_SEEDED}) % 10 AS INT) AS fold, Status AS label, {_RULE} AS prediction FROM frame"
    )
)
def out_of_fold_predictions(spark, sf_dir):
    df = frame(spark, sf_dir)
    dealt, cuts = folds.fold_scheme(df, 0, _SHUFFLED, config.TARGET_COLUMN)
    pooled = experiment.out_of_fold(stage(dealt, "dealt"), cuts, _BetweenNeighbours(), SPEC)
    return pooled.select("row_idx", "fold", "label", "prediction")


_CELLS = (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))


def _confusion_sql(source: str) -> str:
    counts = [f"CAST(count(*) FILTER (Status = {y} AND {_RULE} = {p}) AS BIGINT) AS {c}" for c, y, p in _CELLS]
    shares = [f"CAST(count(*) FILTER (Status = {y} AND {_RULE} = {p}) AS DOUBLE) / count(*) AS {c}_share" for c, y, p in _CELLS]
    return f"SELECT {', '.join(counts + shares)} FROM {source}"


@query(
    _sql(_confusion_sql("frame")),
    rounded=('tn_share', 'fp_share', 'fn_share', 'tp_share'),
)
def out_of_fold_confusion(spark, sf_dir):
    df = frame(spark, sf_dir)
    dealt, cuts = folds.fold_scheme(df, 0, _SHUFFLED, config.TARGET_COLUMN)
    return metrics.confusion(experiment.out_of_fold(stage(dealt, "dealt"), cuts, _BetweenNeighbours(), SPEC))


@query(
    _sql(_confusion_sql(f"frame, size WHERE row_idx >= {_TRAIN}")),
    rounded=('tn_share', 'fp_share', 'fn_share', 'tp_share'),
)
def holdout_confusion_of_rule(spark, sf_dir):
    _, _, train, test = _split(spark, sf_dir)
    return metrics.confusion(experiment.holdout_test(train, test, _BetweenNeighbours(), SPEC)[1])


def _utilities(spark, sf_dir):
    """Two utilities: the meters with an even and with an odd number."""
    df = experiment_frame(derived_warehouse(spark, sf_dir), SINCE, keep=("METER_ID",))
    side = F.col("METER_ID") % 2
    return df.where(side == 0), df.where(side == 1)


@query(
    warehouse_query(
        _confusion_sql("(SELECT *, label AS Status FROM wide WHERE METER_ID % 2 = 1)"),
        PROBES["labelled"], context_ctes("labelled"),
    ),
    rounded=('tn_share', 'fp_share', 'fn_share', 'tp_share'),
)
def cross_dataset_confusion_of_rule(spark, sf_dir):
    even, odd = _utilities(spark, sf_dir)
    return metrics.confusion(experiment.cross_dataset_test(even, odd, _BetweenNeighbours(), SPEC))


@query(
    _sql(
        f"SELECT t.row_idx, t.Status AS label, CASE WHEN CAST(CAST('0x' || substr(md5(concat('0', ':', CAST(t.row_idx AS VARCHAR))), 1, 12) AS BIGINT) AS DOUBLE) "
        f"/ {float(16**12)!r} < share THEN 1 ELSE 0 END AS prediction FROM frame t, size, "
        f"(SELECT avg(CAST(Status AS DOUBLE)) AS share FROM frame, size WHERE row_idx < {_TRAIN}) s WHERE t.row_idx >= {_TRAIN}"
    )
)
def dummy_predictions(spark, sf_dir):
    _, _, train, test = _split(spark, sf_dir)
    return fit(learner("dummy"), train, SPEC).transform(test).select("row_idx", "label", "prediction")


def _distance_sql(a: str, b: str) -> str:
    differ = " + ".join(f"CASE WHEN {a}.{c} = {b}.{c} THEN 0 ELSE 2 END" for c in _CATS)
    gaps = " + ".join(
        f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in [f"z_{c}" for c in _NUMS] + list(_BINS)
    )
    return f"round({differ} + {gaps}, 9)"


@query(
    _sql(
        "SELECT q AS row_idx, label, avg(vote) AS p1, CASE WHEN avg(vote) > 0.5 THEN 1 ELSE 0 END AS prediction FROM ("
        "SELECT a.row_idx AS q, a.Status AS label, CAST(b.Status AS DOUBLE) AS vote, "
        f"row_number() OVER (PARTITION BY a.row_idx ORDER BY {_distance_sql('a', 'b')}, b.row_idx) AS nth "
        f"FROM scaled a, scaled b, size WHERE a.row_idx >= {_TRAIN} AND b.row_idx < {_TRAIN}) WHERE nth <= 5 GROUP BY q, label",
        _scaled_sql(f"row_idx < {_TRAIN}"),
    ),
    rounded=('p1',),
)
def neighbour_predictions(spark, sf_dir):
    """Five-neighbour vote on the hold-out, categories taken over all rows."""
    df, _, train, test = _split(spark, sf_dir)
    scored = fit(learner("neighbours"), train, SPEC, vocabulary_from=df).transform(test)
    return scored.select("row_idx", "label", "p1", "prediction")


_DRAW = "CAST('0x' || substr(md5(concat('0', ':', CAST(i AS VARCHAR))), 1, 12) AS BIGINT)"


@query(
    _sql(
        "SELECT draw, query_id, neighbour_id, rank, sqrt(d2) AS distance FROM ("
        f"SELECT i AS draw, a.row_idx AS query_id, b.row_idx AS neighbour_id, {_distance_sql('a', 'b')} AS d2, "
        f"CAST(row_number() OVER (PARTITION BY i ORDER BY {_distance_sql('a', 'b')}, b.row_idx) AS INT) AS rank "
        f"FROM range(10) g(i), size, scaled a, scaled b WHERE a.row_idx = {_DRAW} % n AND b.row_idx <> a.row_idx) WHERE rank <= 5",
        _scaled_sql(),
    ),
    rounded=('distance',),
)
def neighbour_audit(spark, sf_dir):
    df = frame(spark, sf_dir)
    encoding = fit_encoding(df, SPEC)
    return duplicates.neighbour_audit(encoding.transform(df), df.count(), encoding.width_hot)


@query(
    _sql(
        "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (sqrt(d2) <= CAST(3.0 AS DOUBLE)) AS BIGINT) AS n_near, "
        "CAST(count(*) FILTER (sqrt(d2) <= CAST(3.0 AS DOUBLE)) AS DOUBLE) / count(*) AS rate FROM ("
        f"SELECT a.row_idx, min({_distance_sql('a', 'b')}) AS d2 FROM scaled a, scaled b WHERE a.row_idx <> b.row_idx GROUP BY a.row_idx)",
        _scaled_sql(),
    ),
    rounded=('rate',),
)
def near_duplicates(spark, sf_dir):
    df = frame(spark, sf_dir)
    encoding = fit_encoding(df, SPEC)
    return duplicates.near_duplicate_rate(encoding.transform(df), encoding.width_hot, 3.0)


_SAME = ", ".join((*_CATS, *_BINS))


@query(
    _sql(
        f"SELECT {_SAME}, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(Status) AS BIGINT) AS n_accepted FROM frame "
        f"GROUP BY {_SAME} HAVING count(*) > 1"
    )
)
def exact_twins(spark, sf_dir):
    return duplicates.twins(frame(spark, sf_dir), SPEC)


def _holdout_scores(name: str, **params):
    def run(spark, sf_dir):
        df, _, train, test = _split(spark, sf_dir)
        _, scored = experiment.holdout_test(train, test, learner(name, **params), SPEC, vocabulary_from=df)
        return scored_columns(scored, "row_idx")

    run.__name__ = f"{name}_predictions"
    run.__doc__ = f"Hold-out rows scored by the {name} learner."
    return run


def _bayes_sql() -> str:
    """Gaussian naive Bayes from counts, for the hold-out rows."""
    xs = [f"z_{c}" for c in _NUMS] + list(_BINS)
    numbers = "numbers AS (" + " UNION ALL ".join(
        f"SELECT row_idx, Status, {i} AS j, CAST({x} AS DOUBLE) AS x FROM scaled" for i, x in enumerate(xs)
    ) + ")"
    train = f"(SELECT * FROM numbers, size WHERE row_idx < {_TRAIN})"
    return _sql(
        "SELECT row_idx, Status AS label, CASE WHEN max(CASE WHEN c = 1 THEN total END) > max(CASE WHEN c = 0 THEN total END) THEN 1 ELSE 0 END AS prediction "
        "FROM (SELECT t.row_idx, t.Status, k.c, k.const + h.change + g.fit AS total FROM frame t, size, constants k, "
        "(SELECT l.row_idx, s.c, sum(s.change) AS change FROM long l JOIN vocabulary USING (i, value) JOIN shares s USING (slot) GROUP BY 1, 2) h, "
        "(SELECT x.row_idx, q.c, -sum((x.x - q.m) * (x.x - q.m) / (2 * q.v)) AS fit FROM numbers x JOIN spread q USING (j) GROUP BY 1, 2) g "
        f"WHERE t.row_idx >= {_TRAIN} AND h.row_idx = t.row_idx AND g.row_idx = t.row_idx AND h.c = k.c AND g.c = k.c) GROUP BY 1, 2",
        _LONG, _VOCABULARY, _scaled_sql(f"row_idx < {_TRAIN}"), numbers,
        f"known AS (SELECT row_idx, Status, i, value FROM frame JOIN long USING (row_idx), size WHERE row_idx < {_TRAIN})",
        f"sides AS (SELECT Status AS c, CAST(count(*) AS DOUBLE) AS k FROM frame, size WHERE row_idx < {_TRAIN} GROUP BY 1)",
        "hits AS (SELECT Status AS c, slot, count(*) AS n FROM known JOIN vocabulary USING (i, value) GROUP BY 1, 2)",
        "overall AS (SELECT slot, sum(n) / (SELECT sum(k) FROM sides) AS p FROM hits GROUP BY slot)",
        f"floors AS (SELECT 1e-9 * greatest((SELECT max(p * (1 - p)) FROM overall), (SELECT max(v) FROM (SELECT j, var_pop(x) AS v FROM {train} GROUP BY j))) AS f)",
        "shares AS (SELECT c, slot, p, v, (p * p - (1 - p) * (1 - p)) / (2 * v) AS change FROM (SELECT s.c, w.slot, coalesce(n, 0) / k AS p, "
        "coalesce(n, 0) / k * (1 - coalesce(n, 0) / k) + f AS v FROM sides s CROSS JOIN vocabulary w CROSS JOIN floors LEFT JOIN hits USING (c, slot)))",
        f"spread AS (SELECT Status AS c, j, avg(x) AS m, var_pop(x) + f AS v FROM {train}, floors GROUP BY Status, j, f)",
        "constants AS (SELECT c, ln(k / (SELECT sum(k) FROM sides)) + (SELECT sum(-0.5 * ln(2 * pi() * v) - p * p / (2 * v)) FROM shares WHERE shares.c = sides.c) "
        "+ (SELECT sum(-0.5 * ln(2 * pi() * v)) FROM spread WHERE spread.c = sides.c) AS const FROM sides)",
    )


@query(_bayes_sql())
def bayes_predictions(spark, sf_dir):
    df, _, train, test = _split(spark, sf_dir)
    scored = experiment.holdout_test(train, test, learner("bayes"), SPEC, vocabulary_from=df)[1]
    return scored.select("row_idx", "label", "prediction")


for _name in ("tree", "logit", "network", "rectified_network", "perceptron", "passive_aggressive", "linear_svm"):
    query()(_holdout_scores(_name))


@query()
def tree_node_table(spark, sf_dir):
    df, _, train, _ = _split(spark, sf_dir)
    return tree_nodes(spark, fit(learner("tree"), train, SPEC, vocabulary_from=df).model)


_RAW = " UNION ALL ".join(
    f"SELECT row_idx, CAST(w + {i} AS INT), CAST({c} AS DOUBLE) FROM frame, width" for i, c in enumerate((*_NUMS, *_BINS))
)
_CELLS_OF_ROWS = (
    "width AS (SELECT count(*) AS w FROM vocabulary)",
    "hot AS MATERIALIZED (SELECT row_idx, CAST(slot AS INT) AS feature FROM long JOIN vocabulary USING (i, value))",
    f"dense(row_idx, feature, value) AS MATERIALIZED ({_RAW})",
    "cell AS MATERIALIZED (SELECT row_idx, feature, CAST(1 AS DOUBLE) AS value FROM hot UNION ALL SELECT * FROM dense)",
)


def _trees_sql(select: str, member: str, depth: int, *more: str) -> str:
    """``select`` over ``walk``: each row of ``member`` (tree, row_idx, split, label) at every depth of its tree, by a
    search of all splits of all features at every node, and over ``node``, its class counts and split."""
    sides = "(n - ones - {0} + {1}) * CAST(n - ones - {0} + {1} AS DOUBLE)"
    score = (
        "((l - l1) * CAST(l - l1 AS DOUBLE) + l1 * CAST(l1 AS DOUBLE)) / l + "
        f"({sides.format('l', 'l1')} + (ones - l1) * CAST(ones - l1 AS DOUBLE)) / (n - l)"
    )
    half = "CASE WHEN (value + nxt) / 2 >= nxt THEN value ELSE (value + nxt) / 2 END"

    def best(rows: str) -> str:
        return (
            f"tot AS (SELECT tree, node, count(*) AS n, sum(label) AS ones FROM {rows} WHERE split = 'train' GROUP BY tree, node), "
            "open AS (SELECT * FROM tot WHERE ones > 0 AND ones < n), "
            f"slots AS (SELECT r.tree, r.node, feature, count(*) AS k, sum(label) AS k1 FROM {rows} r JOIN hot USING (row_idx) WHERE split = 'train' GROUP BY ALL), "
            f"counted AS (SELECT r.tree, r.node, feature, value, count(*) AS k, sum(label) AS k1 FROM {rows} r JOIN dense USING (row_idx) WHERE split = 'train' GROUP BY ALL), "
            "along AS (SELECT tree, node, feature, value, sum(k) OVER w AS l, sum(k1) OVER w AS l1, lead(value) OVER (PARTITION BY tree, node, feature ORDER BY value) AS nxt "
            "FROM counted WINDOW w AS (PARTITION BY tree, node, feature ORDER BY value ROWS UNBOUNDED PRECEDING)), "
            "choice AS (SELECT tree, node, feature, CAST(0.5 AS DOUBLE) AS threshold, n - k AS l, ones - k1 AS l1, n, ones FROM slots JOIN open USING (tree, node) WHERE k < n "
            f"UNION ALL SELECT tree, node, feature, {half}, l, l1, n, ones FROM along JOIN open USING (tree, node) WHERE nxt IS NOT NULL), "
            f"best AS (SELECT tree, node, feature, threshold FROM (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY {score} DESC, feature, threshold) AS nth FROM choice) WHERE nth = 1)"
        )

    levels = [
        "walk_0 AS MATERIALIZED (SELECT tree, CAST(1 AS BIGINT) AS node, row_idx, split, CAST(label AS BIGINT) AS label FROM member)"
    ]
    for d in range(depth):
        levels.append(f"best_{d} AS MATERIALIZED (WITH {best(f'walk_{d}')} SELECT * FROM best)")
        levels.append(
            f"walk_{d + 1} AS MATERIALIZED (SELECT r.tree, r.node * 2 + CASE WHEN coalesce(c.value, 0) > b.threshold THEN 1 ELSE 0 END AS node, r.row_idx, r.split, r.label "
            f"FROM walk_{d} r JOIN best_{d} b ON b.tree = r.tree AND b.node = r.node LEFT JOIN cell c ON c.row_idx = r.row_idx AND c.feature = b.feature)"
        )
    walk = " UNION ALL ".join(f"SELECT CAST({d} AS INT) AS depth, * FROM walk_{d}" for d in range(depth + 1))
    split = " UNION ALL ".join(f"SELECT * FROM best_{d}" for d in range(depth)) or "SELECT 0 AS tree, 0 AS node, 0 AS feature, 0.5 AS threshold WHERE FALSE"
    return _sql(
        select, _LONG, _VOCABULARY, *_CELLS_OF_ROWS, f"member AS ({member})", *levels, f"walk AS MATERIALIZED ({walk})", f"split AS MATERIALIZED ({split})",
        "node AS MATERIALIZED (SELECT w.tree, w.node, w.depth, CAST(count(*) - sum(label) AS BIGINT) AS class_0, CAST(sum(label) AS BIGINT) AS class_1, any_value(feature) AS feature, "
        "any_value(threshold) AS threshold FROM walk w LEFT JOIN split USING (tree, node) WHERE w.split = 'train' GROUP BY w.tree, w.node, w.depth)",
        *more,
    )


_HOLDOUT = f"SELECT 0 AS tree, row_idx, CASE WHEN row_idx < {_TRAIN} THEN 'train' ELSE 'test' END AS split, Status AS label FROM frame, size"


@query(_trees_sql("SELECT node, depth, class_0, class_1, feature, threshold FROM node", _HOLDOUT, 20))
def exact_tree_nodes(spark, sf_dir):
    """Every node of the exact tree of depth 20 over the train rows, with its class counts and split."""
    df, _, train, _ = _split(spark, sf_dir)
    return fit(learner("exact_tree"), train, SPEC, vocabulary_from=df).model.nodes.drop("tree")


@query(
    _trees_sql(
        "SELECT row_idx, CAST(label AS INT) AS label, CASE WHEN class_1 > class_0 THEN 1 ELSE 0 END AS prediction, CAST(class_1 AS DOUBLE) / (class_0 + class_1) AS p1 FROM ("
        "SELECT *, row_number() OVER (PARTITION BY row_idx ORDER BY depth DESC) AS nth FROM walk WHERE split = 'test') JOIN node USING (tree, node) WHERE nth = 1",
        _HOLDOUT, 20,
    )
)
def exact_tree_predictions(spark, sf_dir):
    """Hold-out rows scored by the exact tree of depth 20."""
    df, _, train, test = _split(spark, sf_dir)
    _, scored = experiment.holdout_test(train, test, learner("exact_tree"), SPEC, vocabulary_from=df)
    return scored.select("row_idx", "label", "prediction", "p1")


_DEALT = (
    "SELECT f AS tree, row_idx, CASE WHEN d <> f THEN 'train' ELSE 'test' END AS split, Status AS label FROM (SELECT row_idx, Status, "
    "(row_number() OVER (PARTITION BY Status ORDER BY md5(concat('0', ':', CAST(row_idx AS VARCHAR))), row_idx) - 1) % 10 AS d FROM frame), range(10) g(f)"
)
_EXPANDING = (
    "SELECT f AS tree, row_idx, CASE WHEN row_idx < n - (10 - f) * (n // 11) THEN 'train' ELSE 'test' END AS split, Status AS label "
    "FROM frame, size, range(10) g(f) WHERE row_idx < n - (9 - f) * (n // 11)"
)


def _cut_sql(select: str, member: str, depth: int) -> str:
    """``select`` over ``cut``: (d, tree, split, value), the accuracy of each tree cut at depths 1 to ``depth``."""
    return _trees_sql(
        select, member, depth,
        "ends AS MATERIALIZED (SELECT w.tree, row_idx, split, label, w.depth, CASE WHEN class_1 > class_0 THEN 1 ELSE 0 END AS said, feature IS NULL AS leaf FROM walk w JOIN node USING (tree, node)), "
        f"cut AS (SELECT d, tree, split, avg(CASE WHEN said = label THEN 1.0 ELSE 0.0 END) AS value FROM ends, range(1, {depth + 1}) g(d) "
        "WHERE depth = d OR (leaf AND depth < d) GROUP BY d, tree, split)",
    )


@query(
    _cut_sql("SELECT CAST(d AS INT) AS max_depth, CAST(tree AS INT) AS fold, split, value FROM cut", _DEALT, 20),
    rounded=("value",),
)
def tree_depth_sweep(spark, sf_dir):
    """Accuracy of exact trees of depth 1 to 20 on each of 10 stratified folds."""
    df = frame(spark, sf_dir)
    dealt = stage(folds.stratified_fold_column(df, config.TARGET_COLUMN, 10, 0), "dealt")
    found = experiment.depth_sweep(dealt, folds.folds_of_column(10), range(1, 21), SPEC)
    return found.select(F.col("params")["max_depth"].cast("int").alias("max_depth"), "fold", "split", "value")


@query(
    _sql(
        "SELECT score, max(low) AS value, any_value(n) AS n FROM (SELECT b.i, b.score, b.n, min((b.t1 - a.t1 + a.k1) / (b.t - a.t + a.n)) "
        "OVER (PARTITION BY a.i ORDER BY b.i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS low FROM point a JOIN point b ON b.i >= a.i) GROUP BY i, score",
        "point AS MATERIALIZED (SELECT *, row_number() OVER w AS i, CAST(sum(n) OVER w AS DOUBLE) AS t, CAST(sum(k1) OVER w AS DOUBLE) AS t1 FROM "
        "(SELECT READ_VALUE AS score, CAST(count(*) AS BIGINT) AS n, sum(Status) AS k1 FROM frame GROUP BY READ_VALUE) WINDOW w AS (ORDER BY score ROWS UNBOUNDED PRECEDING))",
    ),
    rounded=("value",),
)
def isotonic_fit(spark, sf_dir):
    """Isotonic regression of the label on the read value, at every read value."""
    scored = stage(frame(spark, sf_dir).select(F.col("READ_VALUE").alias("score"), F.col("Status").alias("label")), "scored")
    rows = scored.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    return fit_isotonic(scored).apply(rows).select("score", F.col("_cal").alias("value"), "n")


def _calibration(method):
    def run(spark, sf_dir):
        df, n, train, _ = _split(spark, sf_dir)
        size = folds.ordered_train_size(n, _ORDERED.train_share)
        inner_train, inner_test = experiment.holdout(train, size, _ORDERED)
        cuts = folds.expanding_folds(folds.ordered_train_size(size, _ORDERED.train_share), _ORDERED.folds)
        scored = experiment.calibration_test(inner_train, inner_test, learner("bayes"), cuts, SPEC, method, df)
        return metrics.compare_models(scored)

    run.__name__ = f"calibration_{method}"
    run.__doc__ = f"Plain against {method}-calibrated model on the calibration hold-out."
    return run


for _method in ("isotonic", "sigmoid"):
    query()(_calibration(_method))


@query()
def cross_validation_summary(spark, sf_dir):
    """Mean and deviation over sliding folds, every metric."""
    df = frame(spark, sf_dir)
    cuts = folds.sliding_folds(df.count(), 10, 0.8)
    results = experiment.cross_validate(
        df, cuts, learner("bayes"), SPEC, ("accuracy", "precision", "recall"), vocabulary_from=df
    )
    return experiment.summary(results)


@query()
def cross_dataset_scores(spark, sf_dir):
    even, odd = _utilities(spark, sf_dir)
    scored = experiment.cross_dataset_test(even, odd, learner("tree"), SPEC)
    cells = metrics.confusion(scored)
    return cells.withColumn("accuracy", F.col("tn_share") + F.col("tp_share"))


@query()
def grid_search_summary(spark, sf_dir):
    """Best setting per classifier over 10 stratified folds: the declared grids of neighbours, tree depths 1 to 20 and logit."""
    df = frame(spark, sf_dir)
    dealt = stage(folds.stratified_fold_column(df, config.TARGET_COLUMN, 10, 0), "dealt")
    cuts, known = folds.folds_of_column(10), categories(df, SPEC)
    found = experiment.depth_sweep(dealt, cuts, range(1, 21), SPEC, vocabulary_from=known, train_scores=False)
    for name in ("neighbours", "logit"):
        found = found.unionByName(experiment.grid_search(
            dealt, cuts, lambda name=name, **s: learner(name, **s), experiment.TUNING_GRIDS[name], SPEC, vocabulary_from=known, train_scores=False
        ))
    return experiment.best_settings(found)


@query(
    _cut_sql(
        "SELECT 'exact_tree' AS classifier, concat('{\"max_depth\":\"', CAST(d AS VARCHAR), '\"}') AS params, split, 'accuracy' AS metric, avg(value) AS mean, stddev_pop(value) AS std "
        "FROM cut GROUP BY d, split",
        _EXPANDING, 50,
    ),
    rounded=("mean", "std"),
)
def validation_curve_of_depth(spark, sf_dir):
    """Exact trees of every depth from 1 to 50 over 10 expanding folds."""
    df = frame(spark, sf_dir)
    parameter, depths = experiment.VALIDATION_RANGES["exact_tree"]
    return experiment.summary(experiment.depth_sweep(df, folds.expanding_folds(df.count(), 10), depths, SPEC))


@query()
def learning_curve_shuffled(spark, sf_dir):
    """Naive Bayes on 5 to 95 per cent of each of 10 stratified folds' train rows."""
    df = frame(spark, sf_dir)
    dealt = stage(folds.stratified_fold_column(df, config.TARGET_COLUMN, 10, 0), "dealt")
    shares = run.curve_fractions(_SHUFFLED)
    found = experiment.learning_curve(dealt, folds.folds_of_column(10), learner("bayes"), shares, SPEC, vocabulary_from=df)
    return experiment.curve_summary(found)


_CURVE_SQL = (
    "(SELECT CAST(floor(CAST(0.9 AS DOUBLE) * n * k / 20) AS BIGINT) AS size, CAST(floor(CAST(0.9 AS DOUBLE) * n * k / 20) AS BIGINT) + 1 AS m "
    "FROM size, range(1, 21) h(k) WHERE floor(CAST(0.9 AS DOUBLE) * n * k / 20) >= 10)"
)


@query(
    _sql(
        f"SELECT CAST(size AS BIGINT) AS size, split, avg(value) AS mean, stddev_pop(value) AS std FROM (SELECT size, i, "
        f"CASE WHEN row_idx < m - (10 - i) * (m // 11) THEN 'train' ELSE 'test' END AS split, {_HIT} AS value "
        f"FROM {_CURVE_SQL} s, frame, range(10) g(i) WHERE row_idx < m - (9 - i) * (m // 11) GROUP BY ALL) GROUP BY 1, 2"
    ),
    rounded=('mean', 'std'),
)
def learning_curve_expanding_of_rule(spark, sf_dir):
    """All 20 sizes of 10 expanding folds each, in one pass; a prefix of fewer than 11 rows has no 10 folds."""
    df = frame(spark, sf_dir)
    found = experiment.expanding_learning_curve(df, run.curve_sizes(df.count(), 20, 10), 10, _BetweenNeighbours(), SPEC)
    return experiment.curve_summary(found).select("size", "split", "mean", "std")


@query()
def learning_curve_expanding(spark, sf_dir):
    """Naive Bayes on all 20 sizes of 10 expanding folds each, every metric."""
    df = frame(spark, sf_dir)
    found = experiment.expanding_learning_curve(
        df, run.curve_sizes(df.count(), 20, 10), 10, learner("bayes"), SPEC, ("accuracy", "precision", "recall")
    )
    return experiment.curve_summary(found)
