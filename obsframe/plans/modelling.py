"""Model workflow queries: preparation, transforms, algorithms, resampling, metrics, experiments."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsframe.functions.scalar import hash_fold
from obsframe.ml import algorithms as A
from obsframe.ml import experiment as E
from obsframe.ml import metrics as M
from obsframe.ml import prepare as P
from obsframe.ml import resample as S
from obsframe.ml import together as T
from obsframe.ml import transforms as X
from obsframe.operators import neighbours
from obsframe.plans.binding import READ, readings, table
from obsframe.plans.stations import rounded
from obsframe.plans.registry import query
from obsframe.session import pin

ITEM_IDS = ["l_orderkey", "l_linenumber"]
ITEM_X = ["l_quantity", "l_discount", "l_tax"]
DOC_X = ["kchars", "commas"]


def items(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(*ITEM_IDS, "l_partkey", "l_extendedprice", *ITEM_X)


def documents(spark, sf, how: str = "inner") -> DataFrame:
    """Documents with their labels; the whole text is read for its commas."""
    text = F.col("text")
    docs = table(spark, sf, "documents").select(
        "doc_id", (F.col("n_chars").cast("double") / 1000).alias("kchars"),
        (F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))).cast("double").alias("commas"), "lang", "source",
    )
    return docs.join(table(spark, sf, "labels"), "doc_id", how)


DOCS = """docs AS (SELECT d.doc_id, CAST(n_chars AS DOUBLE)/1000 AS kchars, CAST(length(text)-length(replace(text, ',', '')) AS DOUBLE) AS commas, lang, source, quality, toxic
 FROM documents d LEFT JOIN labels l ON l.doc_id=d.doc_id), labelled AS (SELECT * FROM docs WHERE quality IS NOT NULL)"""


def _hash(seed: int, *cols: str) -> str:
    text = " || ':' || ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"md5({text} || ':{seed}')"


def _number(seed: int, *cols: str) -> str:
    return f"('0x' || substr({_hash(seed, *cols)},1,8))::BIGINT"


ITEM_HASH = ("l_orderkey", "l_linenumber")


@query("ml_divide", f"""WITH {DOCS} SELECT doc_id, kchars, commas, lang, source, toxic FROM labelled""")
def divide(spark, sf):
    x, _ = P.divide(documents(spark, sf), "quality", ["doc_id"])
    return x


@query("ml_split", f"""WITH {DOCS}, r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {_hash(7, "doc_id")}) AS pos, count(*) OVER (PARTITION BY quality) AS n FROM labelled)
SELECT doc_id, quality, CASE WHEN pos <= ceil(n*0.8) THEN 'train' ELSE 'validation' END AS part FROM r UNION ALL SELECT doc_id, NULL, 'test' FROM docs WHERE quality IS NULL""")
def split(spark, sf):
    return P.split(documents(spark, sf, "left").select("doc_id", "quality"), "quality", ["doc_id"], by="value")


@query("ml_split_numeric", f"""WITH {DOCS}, k AS (SELECT doc_id, CASE WHEN quality IS NOT NULL THEN kchars END AS kchars FROM docs),
q AS (SELECT quantile_cont(kchars,[0.2,0.4,0.6,0.8]) AS cuts FROM k), g AS (SELECT doc_id, kchars, len(list_filter(cuts, lambda c: kchars > c)) AS grp FROM k, q WHERE kchars IS NOT NULL),
r AS (SELECT doc_id, kchars, row_number() OVER (PARTITION BY grp ORDER BY {_hash(7, "doc_id")}) AS pos, count(*) OVER (PARTITION BY grp) AS n FROM g)
SELECT doc_id, kchars, CASE WHEN pos <= ceil(n*0.8) THEN 'train' ELSE 'validation' END AS part FROM r UNION ALL SELECT doc_id, NULL, 'test' FROM k WHERE kchars IS NULL""")
def split_numeric(spark, sf):
    """A number is stratified by its quantile groups; documents without a label have no response here."""
    response = F.when(F.col("quality").isNotNull(), F.col("kchars")).alias("kchars")
    return P.split(documents(spark, sf, "left").select("doc_id", response), "kchars", ["doc_id"])


@query("ml_filter_complete", f"""WITH {READ} SELECT station, date, value, source FROM readings WHERE value IS NOT NULL""")
def filter_complete(spark, sf):
    return P.complete_cases(readings(spark, sf), ["value"])


@query("ml_select_uncorrelated", """SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_discount FROM lineitem""")
def select_uncorrelated(spark, sf):
    df = items(spark, sf).withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    step = P.select_uncorrelated(df, ["l_extendedprice", "net", "l_quantity", "l_discount"], 0.97)
    return step(df).select(*ITEM_IDS, *[c for c in ("l_extendedprice", "net", "l_quantity", "l_discount") if c not in step.learnt["dropped"]])


@query("ml_select_variation", """SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem""")
def select_variation(spark, sf):
    df = table(spark, sf, "lineitem").select(
        *ITEM_IDS, "l_quantity", "l_returnflag", F.lit(1).alias("constant"), (F.col("l_quantity") >= 50).cast("int").alias("rare")
    )
    return P.select_varying(df, ["l_quantity", "l_returnflag", "constant", "rare"])(df)


@query("ml_polynomial", """SELECT l_orderkey, l_linenumber, l_quantity, power(l_quantity,2) AS l_quantity_2, power(l_quantity,3) AS l_quantity_3 FROM lineitem""")
def polynomial(spark, sf):
    return P.polynomial(items(spark, sf).select(*ITEM_IDS, "l_quantity"), ["l_quantity"], 3)


@query("ml_seed", f"""SELECT o_orderkey, CAST({_number(7, "o_orderkey")} % 10 AS INTEGER) AS fold FROM orders""")
def seed(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", hash_fold(10, P.SEED, "o_orderkey").alias("fold"))


@query("ml_dummy", """SELECT o_orderkey, CAST(o_orderstatus='O' AS INTEGER) AS "o_orderstatus_O", CAST(o_orderstatus='P' AS INTEGER) AS "o_orderstatus_P" FROM orders""")
def dummy(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return P.dummies(df, "o_orderstatus")(df)


@query("ml_impute_median", f"""WITH {READ}, m AS (SELECT median(value) AS md FROM readings WHERE date < DATE '1999-01-01') SELECT station, date, source, coalesce(value, md) AS value FROM readings, m""")
def impute_median(spark, sf):
    df = readings(spark, sf)
    return P.impute_median(df.where("date < DATE '1999-01-01'"), ["value"])(df)


@query("ml_impute_mode", f"""WITH {READ}, c AS (SELECT value, count(*) AS n FROM readings WHERE value IS NOT NULL AND date < DATE '1999-01-01' GROUP BY 1),
m AS (SELECT value AS md FROM c ORDER BY n DESC, value LIMIT 1) SELECT station, date, source, coalesce(value, md) AS value FROM readings, m""")
def impute_mode(spark, sf):
    df = readings(spark, sf)
    return P.impute_mode(df.where("date < DATE '1999-01-01'"), ["value"])(df)


@query("ml_impute_model", """WITH f AS (SELECT regr_slope(l_quantity, l_extendedprice) AS b, regr_intercept(l_quantity, l_extendedprice) AS a FROM lineitem WHERE l_linenumber<>7)
SELECT l_orderkey, l_linenumber, l_extendedprice, round(CASE WHEN l_linenumber=7 THEN a+b*l_extendedprice ELSE l_quantity END,4) AS value FROM lineitem, f""")
def impute_model(spark, sf):
    df = items(spark, sf).select(
        *ITEM_IDS, "l_extendedprice", F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("value")
    )

    def fit(train):
        column = S.linear_predictor(train, ["l_extendedprice"], "value")
        return lambda d: d.withColumn("prediction", column)

    return rounded(P.impute_model(df, "value", fit)(df), "value", digits=4)


@query("pp_center_scale", """WITH s AS (SELECT avg(l_quantity) a, stddev_samp(l_quantity) b, avg(l_extendedprice) c, stddev_samp(l_extendedprice) d FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity-a)/b,6) AS l_quantity, round((l_extendedprice-c)/d,6) AS l_extendedprice FROM lineitem, s""")
def center_scale(spark, sf):
    df = items(spark, sf).select(*ITEM_IDS, "l_quantity", "l_extendedprice")
    return rounded(X.center_scale(df, ["l_quantity", "l_extendedprice"])(df), "l_quantity", "l_extendedprice")


@query("pp_range", """WITH s AS (SELECT min(l_quantity) a, max(l_quantity) b, min(l_extendedprice) c, max(l_extendedprice) d FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity-a)/(b-a),6) AS l_quantity, round((l_extendedprice-c)/(d-c),6) AS l_extendedprice FROM lineitem, s""")
def to_range(spark, sf):
    df = items(spark, sf).select(*ITEM_IDS, "l_quantity", "l_extendedprice")
    return rounded(X.to_range(df, ["l_quantity", "l_extendedprice"])(df), "l_quantity", "l_extendedprice")


_LAMBDAS = "(SELECT unnest([" + ",".join(f"{v!r}::DOUBLE" for v in X.LAMBDAS) + "]) AS lam)"


@query("pp_boxcox", f"""WITH t AS (SELECT lam, x, CASE WHEN abs(lam)<1e-9 THEN ln(x) ELSE (power(x,lam)-1)/lam END AS z FROM (SELECT o_totalprice AS x FROM orders), {_LAMBDAS}),
s AS (SELECT lam, -count(*)/2.0*ln(var_pop(z))+(lam-1)*sum(ln(x)) AS ll FROM t GROUP BY lam), b AS (SELECT lam FROM s ORDER BY ll DESC LIMIT 1)
SELECT o_orderkey, lam AS power_used, round(CASE WHEN abs(lam)<1e-9 THEN ln(o_totalprice) ELSE (power(o_totalprice,lam)-1)/lam END,3) AS o_totalprice FROM orders, b""")
def boxcox(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    step = X.boxcox(df, "o_totalprice")
    return rounded(step(df).withColumn("power_used", F.lit(step.learnt["lambda"])), "o_totalprice", digits=3)


_YJ = """CASE WHEN x>=0 THEN (CASE WHEN abs(lam)<1e-9 THEN ln(x+1) ELSE (power(x+1,lam)-1)/lam END) ELSE (CASE WHEN abs(lam-2)<1e-9 THEN -ln(1-x) ELSE -(power(1-x,2-lam)-1)/(2-lam) END) END"""


@query("pp_yeojohnson", f"""WITH d AS (SELECT c_custkey, c_acctbal/1000 AS x FROM customer), t AS (SELECT lam, x, {_YJ} AS z FROM d, {_LAMBDAS}),
s AS (SELECT lam, -count(*)/2.0*ln(var_pop(z))+(lam-1)*sum(sign(x)*ln(abs(x)+1)) AS ll FROM t GROUP BY lam), b AS (SELECT lam FROM s ORDER BY ll DESC LIMIT 1)
SELECT c_custkey, lam AS power_used, round({_YJ},5) AS thousands FROM d, b""")
def yeojohnson(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("thousands"))
    step = X.yeojohnson(df, "thousands")
    return rounded(step(df).withColumn("power_used", F.lit(step.learnt["lambda"])), "thousands", digits=5)


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", array_to_vector("embedding").alias("features"))


@query("pp_pca")
def pca(spark, sf):
    df = vectors(spark, sf)
    return X.pca(df, "features", 3)(df).drop("features")


@query("pp_spatial_sign", """SELECT l_orderkey, l_linenumber, round(l_quantity/sqrt(l_quantity*l_quantity+l_tax*l_tax),8) AS l_quantity, round(l_tax/sqrt(l_quantity*l_quantity+l_tax*l_tax),8) AS l_tax FROM lineitem""")
def spatial_sign(spark, sf):
    df = X.spatial_sign(items(spark, sf).select(*ITEM_IDS, "l_quantity", "l_tax"), ["l_quantity", "l_tax"])
    return rounded(df, "l_quantity", "l_tax", digits=8)


@query("pp_knn_impute", f"""WITH {DOCS}, s AS (SELECT avg(kchars) a, stddev_samp(kchars) b, avg(commas) c, stddev_samp(commas) d FROM docs),
z AS (SELECT doc_id, quality, (kchars-a)/b AS x, (commas-c)/d AS y FROM docs, s),
n AS (SELECT q.doc_id, r.quality, row_number() OVER (PARTITION BY q.doc_id ORDER BY round(sqrt(power(q.x-r.x,2)+power(q.y-r.y,2)),9), r.doc_id) AS rn FROM z q, z r WHERE q.quality IS NULL AND r.quality IS NOT NULL)
SELECT doc_id, avg(quality) AS quality FROM n WHERE rn<=5 GROUP BY doc_id UNION ALL SELECT doc_id, quality FROM z WHERE quality IS NOT NULL""")
def knn_impute(spark, sf):
    """Unlabelled documents take the mean label of their five nearest labelled ones."""
    df = pin(documents(spark, sf, "left").select("doc_id", "quality", *DOC_X))  # the texts are read once
    z = X.center_scale(df, DOC_X)(df).select("doc_id", "quality", F.array(*DOC_X).alias("v"))
    known, missing = z.where("quality IS NOT NULL"), z.where("quality IS NULL")
    near = neighbours.nearest(missing, known, "doc_id", "v", 5)
    filled = neighbours.average(near, known, "doc_id", "quality").select(
        F.col("query_id").alias("doc_id"), F.col("prediction").alias("quality")
    )
    return known.select("doc_id", F.col("quality").cast("double").alias("quality")).unionByName(filled)


@query("pp_median_impute", f"""WITH {READ}, m AS (SELECT median(value) AS md FROM readings) SELECT station, date, source, coalesce(value, md) AS value FROM readings, m""")
def median_impute(spark, sf):
    df = readings(spark, sf)
    return P.impute_median(df, ["value"])(df)


@query("pp_bag_impute")
def bag_impute(spark, sf):
    df = items(spark, sf).select(
        *ITEM_IDS, "l_extendedprice", "l_partkey", F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("value")
    )
    step = P.impute_model(df, "value", lambda train: A.fit(train, "treebag", "regression", ["l_extendedprice", "l_partkey"], "value", maxDepth=4))
    return rounded(step(df), "value", digits=4)


@query("pp_fit_apply", """WITH s AS (SELECT avg(l_quantity) a, stddev_samp(l_quantity) b FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01')
SELECT l_orderkey, l_linenumber, round((l_quantity-a)/b,6) AS l_quantity FROM lineitem, s WHERE l_shipdate >= TIMESTAMP '1999-01-01'""")
def fit_apply(spark, sf):
    df = table(spark, sf, "lineitem")
    before = F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz")
    step = X.center_scale(df.where(before), ["l_quantity"])
    return rounded(step(df.where(~before).select(*ITEM_IDS, "l_quantity")), "l_quantity")


_LINE = """f AS (SELECT regr_slope(l_extendedprice,l_quantity) AS b, regr_intercept(l_extendedprice,l_quantity) AS a FROM lineitem)"""


@query("alg_lm", f"""WITH {_LINE} SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, round(a+b*l_quantity,2) AS prediction FROM lineitem, f""")
def alg_lm(spark, sf):
    df = items(spark, sf).select(*ITEM_IDS, "l_quantity", "l_extendedprice")
    return rounded(A.fit(df, "lm", "regression", ["l_quantity"], "l_extendedprice")(df), "prediction", digits=2)


@query("alg_glm", f"""WITH {_LINE} SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, round(a+b*l_quantity,2) AS prediction FROM lineitem, f""")
def alg_glm(spark, sf):
    df = items(spark, sf).select(*ITEM_IDS, "l_quantity", "l_extendedprice")
    return rounded(A.fit(df, "glm", "regression", ["l_quantity"], "l_extendedprice")(df), "prediction", digits=2)


def _held_out(df: DataFrame, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """Four fifths to train on and the rest to score, by hash."""
    fold = hash_fold(5, P.SEED, *ids)
    return df.where(fold != 0), df.where(fold == 0)


def _regression(spark, sf, algorithm: str, **params) -> DataFrame:
    train, test = _held_out(items(spark, sf), ITEM_IDS)
    scored = A.fit(train, algorithm, "regression", ITEM_X, "l_extendedprice", **params)(test)
    out = M.regression_metrics(scored, "l_extendedprice", "prediction")
    return rounded(out.withColumn("algorithm", F.lit(algorithm)), "rmse", "r2", "mae", digits=4)


def _classification(spark, sf, algorithm: str, **params) -> DataFrame:
    train, test = _held_out(documents(spark, sf), ["doc_id"])
    scored = A.fit(train, algorithm, "classification", DOC_X, "quality", **params)(test)
    out = M.classification_metrics(scored.withColumn("prediction", F.col("prediction").cast("int")), "quality", "prediction")
    return rounded(out.withColumn("algorithm", F.lit(algorithm)), "accuracy", "kappa")


def _tree_sql(start: str, depth: int) -> str:
    """Regression trees with exact cuts, one per ``grp`` of ``start``, level by level; nodes are numbered 0, 1 2, 3 4 5 6, ..."""
    out = [f"n0 AS MATERIALIZED ({start})"]
    for k in range(depth):
        long = " UNION ALL ".join(f"SELECT grp, node, '{x}' AS f, {x} AS x, l_extendedprice AS y FROM n{k} WHERE train" for x in ITEM_X)
        side = " ".join(f"WHEN '{x}' THEN {x}" for x in ITEM_X)
        out.append(f"""c{k} AS (SELECT grp, node, f, x, count(*)::DOUBLE AS n, sum(y) AS sy FROM ({long}) GROUP BY ALL),
u{k} AS (SELECT grp, node, f, x, sum(n) OVER u AS nl, sum(sy) OVER u AS sl, sum(n) OVER a AS nt, sum(sy) OVER a AS st FROM c{k}
 WINDOW u AS (PARTITION BY grp, node, f ORDER BY x), a AS (PARTITION BY grp, node, f)),
b{k} AS MATERIALIZED (SELECT grp, node, arg_max(f, sl*sl/nl+(st-sl)*(st-sl)/(nt-nl)) AS f, arg_max(x, sl*sl/nl+(st-sl)*(st-sl)/(nt-nl)) AS cut FROM u{k} WHERE nt > nl GROUP BY grp, node),
n{k + 1} AS MATERIALIZED (SELECT n{k}.* EXCLUDE (node), CASE WHEN b.node IS NULL THEN n{k}.node WHEN (CASE b.f {side} END) <= b.cut THEN 2*n{k}.node+1 ELSE 2*n{k}.node+2 END AS node
 FROM n{k} LEFT JOIN b{k} b ON b.node=n{k}.node AND b.grp=n{k}.grp)""")
    return ", ".join(out)


def _leaves_sql(level: int) -> str:
    """Held-out rows with the mean of their leaf when the trees are cut at a level."""
    return f"""(SELECT n.grp, n.l_extendedprice AS y, t.p FROM n{level} n JOIN (SELECT grp, node, avg(l_extendedprice) AS p FROM n{level} WHERE train GROUP BY grp, node) t
 ON t.node=n.node AND t.grp=n.grp WHERE NOT n.train)"""


_RPART = f"""WITH {_tree_sql(f"SELECT *, {_number(P.SEED, *ITEM_HASH)} % 5 <> 0 AS train, 0 AS grp, 0 AS node FROM lineitem", 5)}
SELECT 'rpart' AS algorithm, count(*) AS n, round(sqrt(avg((y-p)*(y-p))),4) AS rmse, round(power(corr(y,p),2),4) AS r2, round(avg(abs(y-p)),4) AS mae FROM {_leaves_sql(5)}"""

for _name, _params in {
    "glmnet": {}, "enet": {}, "rlm": {}, "pcr": {}, "rpart": {"maxDepth": 5, "maxBins": 64}, "treebag": {"maxDepth": 5},
    "rf": {"maxDepth": 5}, "boosted": {"maxDepth": 3},
}.items():
    query(f"alg_{_name}", _RPART if _name == "rpart" else None)(lambda spark, sf, n=_name, p=_params: _regression(spark, sf, n, **p))
for _name, _params in {"logistic": {}, "plr": {}, "svm_linear": {}, "nnet": {}}.items():
    query(f"alg_{_name}")(lambda spark, sf, n=_name, p=_params: _classification(spark, sf, n, **p))

_CLASS = f"""cl AS (SELECT quality, count(*) AS n, avg(kchars) AS mx, avg(commas) AS my, covar_samp(kchars,kchars) AS sxx, covar_samp(kchars,commas) AS sxy, covar_samp(commas,commas) AS syy FROM labelled GROUP BY quality)"""


@query("alg_lda", f"""WITH {DOCS}, {_CLASS}, pl AS (SELECT sum((n-1)*sxx)/(sum(n)-count(*)) AS a, sum((n-1)*sxy)/(sum(n)-count(*)) AS b, sum((n-1)*syy)/(sum(n)-count(*)) AS d, sum(n) AS total FROM cl),
w AS (SELECT quality AS k, (d*mx-b*my)/(a*d-b*b) AS w1, (a*my-b*mx)/(a*d-b*b) AS w2, mx, my, ln(n/total) AS prior FROM cl, pl),
s AS (SELECT doc_id, quality, k, w1*kchars+w2*commas-0.5*(w1*mx+w2*my)+prior AS score FROM labelled, w)
SELECT doc_id, quality, arg_max(k, score) AS prediction FROM s GROUP BY doc_id, quality""")
def alg_lda(spark, sf):
    df = documents(spark, sf).select("doc_id", "quality", *DOC_X)
    return A.fit(df, "lda", "classification", DOC_X, "quality")(df).select("doc_id", "quality", "prediction")


@query("alg_qda", f"""WITH {DOCS}, {_CLASS}, t AS (SELECT sum(n) AS total FROM cl),
s AS (SELECT doc_id, l.quality, c.quality AS k, ln(n/total)-0.5*ln(sxx*syy-sxy*sxy)-0.5*(syy*power(kchars-mx,2)-2*sxy*(kchars-mx)*(commas-my)+sxx*power(commas-my,2))/(sxx*syy-sxy*sxy) AS score FROM labelled l, cl c, t)
SELECT doc_id, quality, arg_max(k, score) AS prediction FROM s GROUP BY doc_id, quality""")
def alg_qda(spark, sf):
    df = documents(spark, sf).select("doc_id", "quality", *DOC_X)
    return A.fit(df, "qda", "classification", DOC_X, "quality")(df).select("doc_id", "quality", "prediction")


@query("alg_nb", f"""WITH {DOCS}, c AS (SELECT quality AS k, count(*) AS n, avg(kchars) AS mx, avg(commas) AS my, var_pop(kchars) AS vx, var_pop(commas) AS vy FROM labelled GROUP BY 1), t AS (SELECT sum(n) AS total FROM c),
s AS (SELECT doc_id, quality, k, ln(n/total)-0.5*ln(vx)-0.5*ln(vy)-0.5*power(kchars-mx,2)/vx-0.5*power(commas-my,2)/vy AS score FROM labelled, c, t)
SELECT doc_id, quality, arg_max(k, score) AS prediction FROM s GROUP BY doc_id, quality""")
def alg_nb(spark, sf):
    df = documents(spark, sf).select("doc_id", "quality", *DOC_X)
    return A.fit(df, "nb", "classification", DOC_X, "quality")(df).select("doc_id", "quality", F.col("prediction").cast("int").alias("prediction"))


@query("alg_earth")
def alg_earth(spark, sf):
    df = items(spark, sf)
    train, test = _held_out(df, ITEM_IDS)
    scored = A.fit(train, "earth", "regression", ["l_partkey"], "l_extendedprice")(test)
    return rounded(M.regression_metrics(scored, "l_extendedprice", "prediction"), "rmse", "r2", "mae", digits=4)


@query("alg_knn", """WITH n AS (SELECT q.vec_id, q.label, r.label AS other, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(sqrt(list_sum(list_transform(list_zip(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), lambda p: (p[1]-p[2])*(p[1]-p[2])))),9), r.vec_id) AS rn
 FROM embeddings q, embeddings r WHERE q.vec_id<>r.vec_id), v AS (SELECT vec_id, label, other, count(*) AS c FROM n WHERE rn<=5 GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, other) AS k FROM v) SELECT vec_id, label, other AS prediction FROM b WHERE k=1""")
def alg_knn(spark, sf):
    """Every vector labelled by its five nearest others."""
    df = table(spark, sf, "embeddings")
    near = neighbours.nearest(df, df, "vec_id", "embedding", 5, skip_self=True)
    votes = neighbours.vote(near, df, "vec_id", "label").withColumnRenamed("query_id", "vec_id")
    return df.select("vec_id", "label").join(votes, "vec_id")


@query("alg_null", """SELECT 'regression' AS task, round(avg(l_extendedprice),4) AS prediction FROM lineitem UNION ALL SELECT 'classification', (SELECT quality FROM labels GROUP BY quality ORDER BY count(*) DESC, quality LIMIT 1)""")
def alg_null(spark, sf):
    mean = A.fit(items(spark, sf), "null", "regression", [], "l_extendedprice")
    common = A.fit(table(spark, sf, "labels"), "null", "classification", [], "quality")
    one = spark.range(1)
    return mean(one).select(F.lit("regression").alias("task"), F.round("prediction", 4).alias("prediction")).unionByName(
        common(one).select(F.lit("classification").alias("task"), F.col("prediction").cast("double").alias("prediction"))
    )


@query("alg_oner", f"""WITH {DOCS}, l AS (SELECT 'lang' AS v, lang AS lv, quality FROM labelled UNION ALL SELECT 'source', source, quality FROM labelled),
c AS (SELECT v, lv, quality, count(*) AS n FROM l GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY v, lv ORDER BY n DESC, quality) AS rn FROM c),
b AS (SELECT v FROM r WHERE rn=1 GROUP BY v ORDER BY sum(n) DESC, v LIMIT 1)
SELECT d.doc_id, d.quality, r.quality AS prediction FROM labelled d, b JOIN r ON r.v=b.v AND r.rn=1 WHERE r.lv = CASE b.v WHEN 'lang' THEN d.lang ELSE d.source END""")
def alg_oner(spark, sf):
    df = documents(spark, sf)
    return A.fit(df, "oner", "classification", ["lang", "source"], "quality")(df).select("doc_id", "quality", "prediction")


_SCORED = "SELECT resample, count(*) AS n, round(sqrt(avg(e*e)),3) AS rmse, round(power(corr(y,p),2),7) AS r2, round(avg(abs(e)),3) AS mae FROM s GROUP BY resample"


def _fold_sql(repeats: int) -> str:
    suffix = (lambda r: f" || '.Rep{r + 1}'") if repeats > 1 else (lambda r: "")
    parts = " UNION ALL ".join(
        f"SELECT l_quantity AS x, l_extendedprice AS y, printf('Fold%02d', {_number(7 + r, *ITEM_HASH)} % 10 + 1){suffix(r)} AS resample, {r} AS rep FROM lineitem"
        for r in range(repeats)
    )
    return f"""WITH l AS ({parts}), c AS (SELECT rep, resample, count(*)::DOUBLE AS n, sum(x) sx, sum(y) sy, sum(x*x) sxx, sum(x*y) sxy FROM l GROUP BY ALL),
t AS (SELECT rep, sum(n) n, sum(sx) sx, sum(sy) sy, sum(sxx) sxx, sum(sxy) sxy FROM c GROUP BY rep),
o AS (SELECT c.resample, t.n-c.n AS n, t.sx-c.sx AS sx, t.sy-c.sy AS sy, t.sxx-c.sxx AS sxx, t.sxy-c.sxy AS sxy FROM c JOIN t USING (rep)),
f AS (SELECT resample, (n*sxy-sx*sy)/(n*sxx-sx*sx) AS b, (sy-(n*sxy-sx*sy)/(n*sxx-sx*sx)*sx)/n AS a FROM o),
s AS (SELECT l.resample, y, a+b*x AS p, y-a-b*x AS e FROM l JOIN f USING (resample)) {_SCORED}"""


def _validated(spark, sf, scheme: S.Scheme) -> DataFrame:
    out = S.resample_linear(items(spark, sf), ["l_quantity"], "l_extendedprice", ITEM_IDS, scheme)
    return rounded(rounded(out, "rmse", "mae", digits=3), "r2", digits=7)


@query("val_cv", _fold_sql(1))
def val_cv(spark, sf):
    return _validated(spark, sf, S.Scheme("cv"))


@query("val_repeated", _fold_sql(3))
def val_repeated(spark, sf):
    return _validated(spark, sf, S.Scheme("repeatedcv"))


_WEIGHT = "CASE " + " ".join(f"WHEN u < '{v}' THEN {i}" for i, v in enumerate(S.POISSON_STEPS)) + f" ELSE {len(S.POISSON_STEPS)} END"
_DRAWS = " UNION ALL ".join(
    f"SELECT 'Resample{b + 1:02d}' AS resample, l_quantity AS x, l_extendedprice AS y, substr({_hash(7 + b // 8, *ITEM_HASH)},{1 + 4 * (b % 8)},4) AS u FROM lineitem"
    for b in range(10)
)


@query("val_boot", f"""WITH d AS ({_DRAWS}), l AS (SELECT resample, x, y, {_WEIGHT} AS w FROM d),
c AS (SELECT resample, sum(w)::DOUBLE AS n, sum(w*x) sx, sum(w*y) sy, sum(w*x*x) sxx, sum(w*x*y) sxy FROM l GROUP BY 1),
f AS (SELECT resample, (n*sxy-sx*sy)/(n*sxx-sx*sx) AS b, (sy-(n*sxy-sx*sy)/(n*sxx-sx*sx)*sx)/n AS a FROM c),
s AS (SELECT l.resample, y, a+b*x AS p, y-a-b*x AS e FROM l JOIN f USING (resample) WHERE w=0) {_SCORED}""")
def val_boot(spark, sf):
    return _validated(spark, sf, S.Scheme("boot"))


@query("val_none", f"""WITH {_LINE}, s AS (SELECT 'Apparent' AS resample, l_extendedprice AS y, a+b*l_quantity AS p, l_extendedprice-a-b*l_quantity AS e FROM lineitem, f) {_SCORED}""")
def val_none(spark, sf):
    return _validated(spark, sf, S.Scheme("none"))


@query("val_loocv", f"""WITH {_LINE}, m AS (SELECT avg(l_quantity) AS mx, regr_sxx(l_extendedprice,l_quantity) AS sxx, count(*) AS n FROM lineitem),
s AS (SELECT 'LeaveOneOut' AS resample, l_extendedprice AS y, (l_extendedprice-a-b*l_quantity)/(1-1.0/n-power(l_quantity-mx,2)/sxx) AS e, l_extendedprice-(l_extendedprice-a-b*l_quantity)/(1-1.0/n-power(l_quantity-mx,2)/sxx) AS p FROM lineitem, f, m) {_SCORED}""")
def val_loocv(spark, sf):
    return _validated(spark, sf, S.Scheme("loocv"))


def scored_documents(spark, sf) -> DataFrame:
    """A probability from the length of a document, so that the checks can know it."""
    p = F.round(F.col("kchars") / (F.col("kchars") + 0.5), 6)
    return documents(spark, sf).select("doc_id", "quality", "lang", p.alias("probability"), (p >= 0.5).cast("int").alias("prediction"))


SCORED = f"""{DOCS}, sc AS (SELECT doc_id, quality, lang, round(kchars/(kchars+0.5),6) AS probability, CAST(round(kchars/(kchars+0.5),6) >= 0.5 AS INTEGER) AS prediction FROM labelled),
cells AS (SELECT quality AS o, prediction AS p, count(*)::DOUBLE AS n FROM sc GROUP BY ALL),
acc AS (SELECT sum(n) FILTER (o=p)/sum(n) AS po, (SELECT sum(a.s*coalesce(b.s,0)) FROM (SELECT o AS k, sum(n) s FROM cells GROUP BY o) a LEFT JOIN (SELECT p AS k, sum(n) s FROM cells GROUP BY p) b USING (k))/power(sum(n),2) AS pe, CAST(sum(n) AS BIGINT) AS n FROM cells)"""


@query("met_default", f"""WITH {SCORED}, {_LINE}, r AS (SELECT count(*) AS n, sqrt(avg(power(l_extendedprice-a-b*l_quantity,2))) AS rmse, power(corr(l_extendedprice,a+b*l_quantity),2) AS r2, avg(abs(l_extendedprice-a-b*l_quantity)) AS mae FROM lineitem, f)
SELECT 'regression' AS task, n, round(rmse,3) AS rmse, round(r2,7) AS r2, round(mae,3) AS mae, NULL::DOUBLE AS accuracy, NULL::DOUBLE AS kappa FROM r
UNION ALL SELECT 'classification', n, NULL, NULL, NULL, round(po,6), round((po-pe)/(1-pe),6) FROM acc""")
def met_default(spark, sf):
    df = items(spark, sf)
    fitted = df.withColumn("prediction", S.linear_predictor(df, ["l_quantity"], "l_extendedprice"))
    reg = rounded(rounded(M.regression_metrics(fitted, "l_extendedprice", "prediction"), "rmse", "mae", digits=3), "r2", digits=7)
    cls = rounded(M.classification_metrics(scored_documents(spark, sf), "quality", "prediction"), "accuracy", "kappa")
    return reg.withColumn("task", F.lit("regression")).unionByName(
        cls.withColumn("task", F.lit("classification")), allowMissingColumns=True
    )


@query("met_two_class", f"""WITH {SCORED}, r AS (SELECT quality, rank() OVER (ORDER BY probability) + (count(*) OVER (PARTITION BY probability) - 1)/2.0 AS rk FROM sc),
c AS (SELECT count(*) FILTER (quality=1)::DOUBLE AS p, count(*) FILTER (quality=0)::DOUBLE AS q FROM sc)
SELECT round(((SELECT sum(rk) FROM r WHERE quality=1)-p*(p+1)/2)/(p*q),6) AS roc, round((SELECT count(*) FROM sc WHERE quality=1 AND probability>=0.5)/p,6) AS sens,
 round((SELECT count(*) FROM sc WHERE quality=0 AND probability<0.5)/q,6) AS spec FROM c""")
def met_two_class(spark, sf):
    return rounded(M.two_class_metrics(scored_documents(spark, sf), "quality", "probability"), "roc", "sens", "spec")


LANGUAGES = ["de", "en", "es", "fr"]
LANGUAGE_P = {v: f"p_{v}" for v in LANGUAGES}


def scored_languages(spark, sf) -> DataFrame:
    """Every labelled document's language by discriminants of the other folds, with the probability of each language."""
    df = documents(spark, sf).where(F.col("lang").isin(LANGUAGES))
    out = T.score_forms(df, "lda", DOC_X, "lang", ["doc_id"], S.Scheme("cv", number=5), probabilities=True)
    return rounded(out, *LANGUAGE_P.values(), digits=9)


# ``long`` has a row per document and language with its probability, ``area`` the areas under both curves of a language against the rest.
_SPOKEN = f"""f AS (SELECT *, {_number(7, "doc_id")} % 5 AS fold FROM labelled WHERE lang IN ('de','en','es','fr')), g AS (SELECT unnest(range(5)) AS grp),
m AS (SELECT grp, lang AS k, count(*)::DOUBLE AS n, avg(kchars) AS mx, avg(commas) AS my, covar_samp(kchars,kchars) AS sxx, covar_samp(kchars,commas) AS sxy, covar_samp(commas,commas) AS syy FROM f, g WHERE fold<>grp GROUP BY grp, lang),
pl AS (SELECT grp, sum((n-1)*sxx)/(sum(n)-count(*)) AS a, sum((n-1)*sxy)/(sum(n)-count(*)) AS b, sum((n-1)*syy)/(sum(n)-count(*)) AS d, sum(n) AS total FROM m GROUP BY grp),
odds AS (SELECT doc_id, lang, k, (d*mx-b*my)/(a*d-b*b)*(kchars-mx/2)+(a*my-b*mx)/(a*d-b*b)*(commas-my/2)+ln(n/total) AS score FROM f JOIN m ON fold=grp JOIN pl USING (grp)),
ex AS (SELECT doc_id, lang, k, exp(score - max(score) OVER (PARTITION BY doc_id)) AS z FROM odds),
long AS (SELECT doc_id, lang, k, round(z/sum(z) OVER (PARTITION BY doc_id),9) AS p, z, CAST(lang=k AS INTEGER) AS event FROM ex),
told AS (SELECT doc_id, lang AS o, arg_max(k, z) AS p FROM long GROUP BY doc_id, lang),
pt AS (SELECT k, p, count(*)::DOUBLE AS n, sum(event)::DOUBLE AS e FROM long GROUP BY k, p),
cu AS (SELECT k, p, n, e, sum(n) OVER w AS called, sum(e) OVER w AS hit, sum(e) OVER (PARTITION BY k) AS ev, sum(n) OVER (PARTITION BY k) AS total FROM pt WINDOW w AS (PARTITION BY k ORDER BY p DESC)),
area AS (SELECT k, (sum(e*(total-called+(n+1)/2))-any_value(ev*(ev+1)/2))/any_value(ev*(total-ev)) AS roc, sum(CASE WHEN called>n THEN e/ev*(hit/called+(hit-e)/(called-n))/2 ELSE 0 END) AS pr FROM cu GROUP BY k),
spoken AS (SELECT o, p, count(*)::DOUBLE AS n FROM told GROUP BY ALL), ks AS (SELECT DISTINCT k FROM (SELECT o AS k FROM spoken UNION SELECT p FROM spoken)),
rates AS (SELECT k, coalesce(sum(n) FILTER (o=k AND p=k),0) AS tp, coalesce(sum(n) FILTER (o=k AND p<>k),0) AS fn, coalesce(sum(n) FILTER (o<>k AND p=k),0) AS fp, sum(n) AS t FROM spoken, ks GROUP BY k),
told_acc AS (SELECT sum(n) FILTER (o=p)/sum(n) AS po, (SELECT sum(a.s*coalesce(b.s,0)) FROM (SELECT o AS k, sum(n) s FROM spoken GROUP BY o) a LEFT JOIN (SELECT p AS k, sum(n) s FROM spoken GROUP BY p) b USING (k))/power(sum(n),2) AS pe, CAST(sum(n) AS BIGINT) AS n FROM spoken)"""
SPOKEN = f"{DOCS}, {_SPOKEN}"


@query("met_multi", f"""WITH {SPOKEN} SELECT any_value(told_acc.n) AS n, round(any_value(po),6) AS accuracy, round(any_value((po-pe)/(1-pe)),6) AS kappa, round(avg(tp/nullif(tp+fn,0)),6) AS mean_sens, round(avg((t-tp-fn-fp)/nullif(t-tp-fn,0)),6) AS mean_spec,
 round(avg(tp/nullif(tp+fp,0)),6) AS mean_precision, round(avg((t-tp-fn-fp)/nullif(t-tp-fp,0)),6) AS mean_npv, round(avg(2*tp/nullif(2*tp+fp+fn,0)),6) AS mean_f1, round(avg(tp/t),6) AS mean_detection,
 round(avg((tp/nullif(tp+fn,0)+(t-tp-fn-fp)/nullif(t-tp-fn,0))/2),6) AS mean_balanced, (SELECT round(avg(roc),6) FROM area) AS auc, (SELECT round(avg(pr),6) FROM area) AS pr_auc,
 (SELECT round(avg(-ln(least(greatest(p,1e-15),1-1e-15))),6) FROM long WHERE lang=k) AS log_loss FROM rates, told_acc""")
def met_multi(spark, sf):
    """Means over four languages, their curves and log loss, of probabilities from other folds."""
    out = M.multi_class_metrics(pin(scored_languages(spark, sf)), "lang", "prediction", LANGUAGE_P)
    return rounded(out, *[c for c in out.columns if c != "n"])


@query("met_logloss", f"""WITH {SCORED}, {_SPOKEN}
SELECT 'quality' AS label, round(avg(-ln(CASE WHEN quality=1 THEN least(greatest(probability,1e-15),1-1e-15) ELSE 1-least(greatest(probability,1e-15),1-1e-15) END)),6) AS log_loss FROM sc
UNION ALL SELECT 'lang', round(avg(-ln(least(greatest(p,1e-15),1-1e-15))),6) FROM long WHERE lang=k""")
def met_logloss(spark, sf):
    """Of two classes, and of four."""
    two = M.log_loss(scored_documents(spark, sf), "quality", "probability").withColumn("label", F.lit("quality"))
    four = M.class_log_loss(scored_languages(spark, sf), "lang", LANGUAGE_P).withColumn("label", F.lit("lang"))
    return rounded(two.unionByName(four), "log_loss")


@query("met_pr", f"""WITH {SCORED}, c AS (SELECT count(*) FILTER (quality=1 AND prediction=1)::DOUBLE AS tp, count(*) FILTER (prediction=1) AS pp, count(*) FILTER (quality=1) AS op FROM sc),
pt AS (SELECT probability AS p, count(*)::DOUBLE AS n, sum(quality)::DOUBLE AS e FROM sc GROUP BY 1), cu AS (SELECT n, e, sum(n) OVER w AS called, sum(e) OVER w AS hit, sum(e) OVER () AS ev FROM pt WINDOW w AS (ORDER BY p DESC)),
area AS (SELECT sum(CASE WHEN called>n THEN e/ev*(hit/called+(hit-e)/(called-n))/2 ELSE 0 END) AS pr FROM cu)
SELECT round(tp/pp,6) AS precision, round(tp/op,6) AS recall, round(2*tp/(pp+op),6) AS f1, round(pr,6) AS pr_auc FROM c, area""")
def met_pr(spark, sf):
    return rounded(M.precision_recall(scored_documents(spark, sf), "quality", "prediction", "probability"), "precision", "recall", "f1", "pr_auc")


@query("met_curves", f"""WITH {SPOKEN} SELECT k AS level, CAST(any_value(ev) AS BIGINT) AS events, any_value(round(roc,6)) AS roc, any_value(round(pr,6)) AS pr FROM cu JOIN area USING (k) GROUP BY k""")
def met_curves(spark, sf):
    """Each language against the rest."""
    return rounded(M.class_curves(scored_languages(spark, sf), "lang", LANGUAGE_P), "roc", "pr")


@query("met_confusion", f"""WITH {SCORED} SELECT lang, quality AS observed, prediction AS predicted, count(*) AS n FROM sc GROUP BY ALL""")
def met_confusion(spark, sf):
    return M.confusion(scored_documents(spark, sf), "quality", "prediction", ["lang"])


@query("met_rank_cor", """WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity)-1)/2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice)-1)/2.0 AS b FROM lineitem)
SELECT round(corr(a,b),7) AS spearman FROM r""")
def met_rank_cor(spark, sf):
    return rounded(M.rank_correlation(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"), "spearman", digits=7)


@query("met_calibration", f"""WITH {SCORED} SELECT CAST(least(floor(probability*10),9) AS INTEGER) AS bin, count(*) AS n, round(avg(probability),6) AS mean_probability, round(avg(CASE WHEN quality=1 THEN 1.0 ELSE 0.0 END),6) AS observed_share,
 round((CAST(least(floor(probability*10),9) AS INTEGER)+0.5)/10,6) AS midpoint FROM sc GROUP BY 1, 5""")
def met_calibration(spark, sf):
    return rounded(M.calibration(scored_documents(spark, sf), "quality", "probability"), "mean_probability", "observed_share", "midpoint")


@query("tun_grid")
def tun_grid(spark, sf):
    return E.tune(items(spark, sf), "glmnet", ITEM_X, "l_extendedprice", ITEM_IDS, {"regParam": [0.1, 10.0], "elasticNetParam": [0.0, 1.0]})


def _tasks() -> list[E.Task]:
    return E.cross(E.Task("price", "l_extendedprice"), algorithm=["lm", "null"], predictor=["l_quantity", "l_tax"])


_TREE = """xcell AS (SELECT name, resample, x, count(*)::DOUBLE AS n, sum(y) AS sy FROM l WHERE algorithm='rpart' GROUP BY ALL),
xall AS (SELECT name, x, sum(n) AS n, sum(sy) AS sy FROM xcell GROUP BY ALL), fold AS (SELECT DISTINCT resample FROM l),
xtrain AS (SELECT a.name, fold.resample, a.x, a.n-coalesce(c.n,0) AS n, a.sy-coalesce(c.sy,0) AS sy FROM xall a CROSS JOIN fold LEFT JOIN xcell c ON c.name=a.name AND c.resample=fold.resample AND c.x=a.x),
xcum AS (SELECT name, resample, x, sum(n) OVER u AS nl, sum(sy) OVER u AS sl, sum(n) OVER a AS nt, sum(sy) OVER a AS st FROM xtrain WINDOW u AS (PARTITION BY name, resample ORDER BY x), a AS (PARTITION BY name, resample)),
tree AS (SELECT name, resample, arg_max(x, sl*sl/nl+(st-sl)*(st-sl)/(nt-nl)) AS cut, arg_max(sl/nl, sl*sl/nl+(st-sl)*(st-sl)/(nt-nl)) AS ml,
 arg_max((st-sl)/(nt-nl), sl*sl/nl+(st-sl)*(st-sl)/(nt-nl)) AS mr FROM xcum WHERE nl > 0 AND nt > nl GROUP BY name, resample)"""


def _task_sql(final: str, tree: tuple[tuple[str, str], ...] = ()) -> str:
    """The experiment in SQL: lines and means from sums, the tree of one split by trying every cut."""
    rows = " UNION ALL ".join(
        f"SELECT 'price_{a}_{p}' AS name, '{a}' AS algorithm, '{p}' AS predictor, {'0.0' if a == 'null' else p} AS x, l_extendedprice AS y, printf('Fold%02d', {_number(7, *ITEM_HASH)} % 10 + 1) AS resample FROM lineitem"
        for a, p in (*((a, p) for a in ("lm", "null") for p in ("l_quantity", "l_tax")), *tree)
    )
    return f"""WITH l AS ({rows}), c AS (SELECT name, resample, count(*)::DOUBLE AS n, sum(x) sx, sum(y) sy, sum(x*x) sxx, sum(x*y) sxy FROM l GROUP BY ALL),
t AS (SELECT name, sum(n) n, sum(sx) sx, sum(sy) sy, sum(sxx) sxx, sum(sxy) sxy FROM c GROUP BY name),
o AS (SELECT c.name, c.resample, t.n-c.n AS n, t.sx-c.sx AS sx, t.sy-c.sy AS sy, t.sxx-c.sxx AS sxx, t.sxy-c.sxy AS sxy FROM c JOIN t USING (name)),
g AS (SELECT *, CASE WHEN n*sxx-sx*sx > 0 THEN (n*sxy-sx*sy)/(n*sxx-sx*sx) ELSE 0 END AS b FROM o), f AS (SELECT name, resample, b, (sy-b*sx)/n AS a FROM g),
{_TREE}, v AS (SELECT l.name, l.algorithm, l.predictor, l.resample, y, CASE WHEN l.algorithm='rpart' THEN CASE WHEN x <= cut THEN ml ELSE mr END ELSE a+b*x END AS p
 FROM l JOIN f ON f.name=l.name AND f.resample=l.resample LEFT JOIN tree t ON t.name=l.name AND t.resample=l.resample), s AS (SELECT *, y-p AS e FROM v),
r AS (SELECT name, algorithm, predictor, resample, count(*) AS n, sqrt(avg(e*e)) AS rmse, CASE WHEN algorithm<>'null' THEN power(corr(y,p),2) END AS r2, avg(abs(e)) AS mae FROM s GROUP BY name, algorithm, predictor, resample) {final}"""


@query("exp_cross", _task_sql("SELECT name, algorithm, predictor, round(avg(rmse),3) AS rmse FROM r GROUP BY ALL"))
def exp_cross(spark, sf):
    out = E.query_table(items(spark, sf), _tasks(), ITEM_IDS, S.Scheme("cv"))
    return rounded(out, "rmse", digits=3).select("name", "algorithm", "predictor", "rmse")


@query("exp_query", _task_sql("SELECT name, algorithm, predictor, round(avg(rmse),3) AS rmse, round(avg(r2),7) AS r2, round(avg(mae),3) AS mae, count(*) AS resamples FROM r GROUP BY ALL", (("rpart", "l_quantity"),)))
def exp_query(spark, sf):
    """Lines, means and a tree of one split; the trees of all folds are grown together."""
    tree = E.cross(E.Task("price", "l_extendedprice"), algorithm=["rpart"], predictor=["l_quantity"])
    out = E.query_table(items(spark, sf), [*_tasks(), *tree], ITEM_IDS, S.Scheme("cv"), rpart={"maxDepth": 1, "maxBins": 64})
    return rounded(rounded(out, "rmse", "mae", digits=3), "r2", digits=7)


@query("exp_trees", f"""WITH {_tree_sql(f"SELECT l.*, {_number(7, *ITEM_HASH)} % 10 <> g.grp AS train, g.grp, 0 AS node FROM lineitem l, (SELECT unnest(range(10)) AS grp) g", 4)},
r AS ({" UNION ALL ".join(f"SELECT {d} AS depth, grp, count(*) AS n, sqrt(avg((y-p)*(y-p))) AS rmse, avg(abs(y-p)) AS mae FROM {_leaves_sql(d)} GROUP BY grp" for d in (1, 4))})
SELECT 'depth_' || depth AS name, printf('Fold%02d', grp + 1) AS resample, n, round(rmse,3) AS rmse, round(mae,3) AS mae FROM r""")
def exp_trees(spark, sf):
    """Trees of three predictors, one and four splits deep, the ten folds of a depth grown together."""
    parts = []
    for depth in (1, 4):
        task = E.Task(f"depth_{depth}", "l_extendedprice", tuple(ITEM_X), "rpart")
        parts.append(E.resample_table(items(spark, sf), [task], ITEM_IDS, S.Scheme("cv"), rpart={"maxDepth": depth, "maxBins": 64}))
    return rounded(parts[0].unionByName(parts[1]), "rmse", "mae", digits=3).select("name", "resample", "n", "rmse", "mae")


_CLASS_FOLDS = f"""f AS (SELECT *, {_number(7, "doc_id")} % 5 AS fold FROM labelled), g AS (SELECT unnest(range(5)) AS grp),
m AS (SELECT grp, quality AS k, count(*)::DOUBLE AS n, avg(kchars) AS mx, avg(commas) AS my, covar_samp(kchars,kchars) AS sxx, covar_samp(kchars,commas) AS sxy, covar_samp(commas,commas) AS syy,
 var_pop(kchars) AS vx, var_pop(commas) AS vy FROM f, g WHERE fold<>grp GROUP BY grp, quality),
o AS (SELECT grp, greatest(var_pop(kchars), var_pop(commas))*1e-9 AS e FROM f, g WHERE fold<>grp GROUP BY grp),
pl AS (SELECT grp, sum((n-1)*sxx)/(sum(n)-count(*)) AS a, sum((n-1)*sxy)/(sum(n)-count(*)) AS b, sum((n-1)*syy)/(sum(n)-count(*)) AS d, sum(n) AS total FROM m GROUP BY grp),
sc AS (
 SELECT 'null' AS algorithm, f.doc_id, grp, quality, k, n AS score FROM f JOIN m ON fold=grp
 UNION ALL SELECT 'lda', f.doc_id, grp, quality, k, (d*mx-b*my)/(a*d-b*b)*(kchars-mx/2)+(a*my-b*mx)/(a*d-b*b)*(commas-my/2)+ln(n/total) FROM f JOIN m ON fold=grp JOIN pl USING (grp)
 UNION ALL SELECT 'nb', f.doc_id, grp, quality, k, ln(n/total)-0.5*(ln(vx+e)+ln(vy+e)+power(kchars-mx,2)/(vx+e)+power(commas-my,2)/(vy+e)) FROM f JOIN m ON fold=grp JOIN pl USING (grp) JOIN o USING (grp)),
ol AS (SELECT grp, v, lv, quality, count(*) AS n FROM (SELECT 'lang' AS v, lang AS lv, quality, fold FROM f UNION ALL SELECT 'source', source, quality, fold FROM f) l, g WHERE fold<>grp GROUP BY ALL),
rl AS (SELECT *, row_number() OVER (PARTITION BY grp, v, lv ORDER BY n DESC, quality) AS rn FROM ol),
bv AS (SELECT grp, arg_min(v, (-s, v)) AS v FROM (SELECT grp, v, sum(n) AS s FROM rl WHERE rn=1 GROUP BY grp, v) GROUP BY grp),
cm AS (SELECT grp, arg_max(k, n*10-k) AS k FROM m GROUP BY grp),
pr AS (
 SELECT algorithm, grp, quality AS o, arg_max(k, score) AS p FROM sc GROUP BY algorithm, grp, doc_id, quality
 UNION ALL SELECT 'oner', bv.grp, f.quality, coalesce(rl.quality, cm.k) FROM f JOIN bv ON bv.grp=fold JOIN cm ON cm.grp=fold
  LEFT JOIN rl ON rl.grp=fold AND rl.v=bv.v AND rl.rn=1 AND rl.lv = CASE bv.v WHEN 'lang' THEN f.lang ELSE f.source END),
ce AS (SELECT algorithm, grp, count(*) AS n, avg(CASE WHEN o=p THEN 1.0 ELSE 0.0 END) AS po, (avg(o)*avg(p)+(1-avg(o))*(1-avg(p))) AS pe FROM pr GROUP BY algorithm, grp)"""


@query("exp_classes", f"""WITH {DOCS}, {_CLASS_FOLDS}
SELECT 'quality_' || algorithm AS name, algorithm, printf('Fold%02d', grp + 1) AS resample, n, round(po,6) AS accuracy, round(CASE WHEN pe=1 THEN 0 ELSE (po-pe)/(1-pe) END,6) AS kappa FROM ce""")
def exp_classes(spark, sf):
    """Class models of five folds: the commonest class, discriminants, naive Bayes and one rule."""
    df = documents(spark, sf)
    tasks = E.cross(E.Task("quality", "quality", tuple(DOC_X), kind="classification"), algorithm=["null", "lda", "nb"])
    tasks.append(E.Task("quality_oner", "quality", ("lang", "source"), "oner", {"algorithm": "oner"}, "classification"))
    return rounded(E.resample_table(df, tasks, ["doc_id"], S.Scheme("cv", number=5)), "accuracy", "kappa")


@query("exp_resample", _task_sql("SELECT name, algorithm, predictor, resample, n, round(rmse,3) AS rmse, round(r2,7) AS r2, round(mae,3) AS mae FROM r"))
def exp_resample(spark, sf):
    out = E.resample_table(items(spark, sf), _tasks(), ITEM_IDS, S.Scheme("cv"))
    return rounded(rounded(out, "rmse", "mae", digits=3), "r2", digits=7)


@query("exp_train_status", """SELECT 'price_' || a AS name, a AS algorithm, a <> 'unknown' AS succeeded, CASE WHEN a='unknown' THEN 1 ELSE 0 END AS errors,
 CASE WHEN a='unknown' THEN 'ValueError: unknown algorithm unknown for regression' ELSE '' END AS messages, '' AS warnings FROM (VALUES ('lm'), ('glmnet'), ('unknown')) t(a)""")
def exp_train_status(spark, sf):
    """Two fits that work and one that cannot."""
    tasks = E.cross(E.Task("price", "l_extendedprice", ("l_quantity",)), algorithm=["lm", "glmnet", "unknown"])
    df = items(spark, sf)
    status = E.run_all(spark, tasks, lambda t: A.fit(df, t.algorithm, "regression", t.predictors, t.response))[1]
    return status.drop("started", "finished", "seconds")  # the clock cannot be compared


_TUNED = " UNION ALL ".join(
    f"SELECT {i + 1} AS index, {d}.0::DOUBLE AS maxDepth, avg(m) AS mae FROM (SELECT grp, avg(abs(y-p)) AS m FROM {_leaves_sql(d)} GROUP BY grp)" for i, d in enumerate((2, 4))
)


@query("exp_tune", f"""WITH {_tree_sql(f"SELECT l.*, {_number(7, *ITEM_HASH)} % 3 <> g.grp AS train, g.grp, 0 AS node FROM lineitem l, (SELECT unnest(range(3)) AS grp) g", 4)}, r AS ({_TUNED})
SELECT CAST(index AS INTEGER) AS index, maxDepth, round(mae,3) AS mae, mae=(SELECT min(mae) FROM r) AS best FROM r""")
def exp_tune(spark, sf):
    """The depth of a tree, tuned by a chosen metric."""
    out = E.tune(items(spark, sf), "rpart", ITEM_X, "l_extendedprice", ITEM_IDS, {"maxDepth": [2, 4]}, metric="mae", fixed={"maxBins": 64})
    return rounded(out, "mae", digits=3)


def _class_tree_sql(depth: int) -> str:
    """Trees of three folds for quality from two whole numbers, level by level, with Gini's gain; nodes are numbered 0, 1 2, 3 4 5 6, ..."""
    pure = "({s}*{s}+({n}-{s})*({n}-{s}))/{n}"
    left, right, whole = pure.format(s="sl", n="nl"), pure.format(s="(st-sl)", n="(nt-nl)"), pure.format(s="st", n="nt")
    out = [f"""n0 AS MATERIALIZED (SELECT doc_id, quality, CAST(floor(kchars) AS DOUBLE) AS a, CAST(floor(commas/10) AS DOUBLE) AS b, {_number(7, "doc_id")} % 3 <> g.grp AS train, g.grp, 0 AS node
 FROM labelled, (SELECT unnest(range(3)) AS grp) g)"""]
    for k in range(depth):
        out.append(f"""c{k} AS (SELECT grp, node, f, x, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS sy FROM (SELECT grp, node, 0 AS f, a AS x, quality AS y FROM n{k} WHERE train UNION ALL SELECT grp, node, 1, b, quality FROM n{k} WHERE train) GROUP BY ALL),
u{k} AS (SELECT grp, node, f, x, sum(n) OVER u AS nl, sum(sy) OVER u AS sl, sum(n) OVER a AS nt, sum(sy) OVER a AS st FROM c{k}
 WINDOW u AS (PARTITION BY grp, node, f ORDER BY x), a AS (PARTITION BY grp, node, f)),
g{k} AS (SELECT *, {left}+{right}-{whole} AS gain, {whole} AS base FROM u{k} WHERE nt > nl),
b{k} AS MATERIALIZED (SELECT grp, node, arg_max(f, (round(gain/base,12), -f, -x)) AS f, arg_max(x, (round(gain/base,12), -f, -x)) AS cut, max(gain/base) > 1e-12 AS useful FROM g{k} GROUP BY grp, node),
n{k + 1} AS MATERIALIZED (SELECT n{k}.* EXCLUDE (node), CASE WHEN b.node IS NULL OR NOT b.useful THEN n{k}.node WHEN (CASE b.f WHEN 0 THEN n{k}.a ELSE n{k}.b END) <= b.cut THEN 2*n{k}.node+1 ELSE 2*n{k}.node+2 END AS node
 FROM n{k} LEFT JOIN b{k} b ON b.node=n{k}.node AND b.grp=n{k}.grp)""")
    return ", ".join(out)


_TUNED_CLASSES = " UNION ALL ".join(f"""SELECT {i + 1} AS index, {d}.0::DOUBLE AS maxDepth, avg(a) AS accuracy FROM (SELECT n.grp, avg(CASE WHEN n.quality = t.p THEN 1.0 ELSE 0.0 END) AS a FROM n{d} n
 JOIN (SELECT grp, node, CASE WHEN avg(quality) > 0.5 THEN 1 ELSE 0 END AS p FROM n{d} WHERE train GROUP BY grp, node) t ON t.node=n.node AND t.grp=n.grp WHERE NOT n.train GROUP BY n.grp)""" for i, d in enumerate((0, 1, 3)))


@query("tun_classes", f"""WITH {DOCS}, {_class_tree_sql(3)}, r AS ({_TUNED_CLASSES})
SELECT CAST(index AS INTEGER) AS index, maxDepth, round(accuracy,6) AS accuracy, index=(SELECT arg_max(index, (accuracy, -index)) FROM r) AS best FROM r""")
def tun_classes(spark, sf):
    """The depth of a tree of classes, tuned by accuracy: no split at all, one, and three in a row."""
    df = documents(spark, sf).withColumns({"a": F.floor("kchars"), "b": F.floor(F.col("commas") / 10)})
    out = E.tune(df, "rpart", ["a", "b"], "quality", ["doc_id"], {"maxDepth": [0, 1, 3]}, task="classification", metric="accuracy", fixed={"maxBins": 2000})
    return rounded(out, "accuracy")


@query("exp_importance")
def exp_importance(spark, sf):
    return A.importance(items(spark, sf), "rf", "regression", ITEM_X, "l_extendedprice", maxDepth=5)


@query("prd_predict", f"""WITH {_LINE} SELECT l_orderkey, l_linenumber, round(a+b*l_quantity,2) AS l_extendedprice_prediction FROM lineitem, f""")
def prd_predict(spark, sf):
    df = items(spark, sf)
    column = S.linear_predictor(df, ["l_quantity"], "l_extendedprice")
    return df.select(*ITEM_IDS, F.round(column, 2).alias("l_extendedprice_prediction"))


@query("prd_augment", f"""WITH {_LINE} SELECT l_orderkey, l_linenumber, l_extendedprice, round(a+b*l_quantity,2) AS l_extendedprice_prediction, round(l_extendedprice-a-b*l_quantity,2) AS l_extendedprice_residual FROM lineitem, f""")
def prd_augment(spark, sf):
    df = items(spark, sf).select(*ITEM_IDS, "l_quantity", "l_extendedprice")
    column = S.linear_predictor(df, ["l_quantity"], "l_extendedprice")
    out = E.augment(df, lambda d: d.withColumn("prediction", column), "l_extendedprice").drop("l_quantity")
    return rounded(out, "l_extendedprice_prediction", "l_extendedprice_residual", digits=2)
