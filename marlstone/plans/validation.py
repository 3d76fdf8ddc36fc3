"""Registered queries of a validation run: orders are answers to a customer's prompt, their states the data sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import validation as V
from .queries import query
from .tables import rollouts, table

DRAWS = 12
RUN_SQL = f"""a AS (SELECT o_orderstatus AS source, o_custkey AS prompt, o_orderkey AS k, (o_totalprice > 150000)::INT::DOUBLE AS acc, o_totalprice / 1000 AS reward, o_orderpriority AS pred FROM orders),
g AS (SELECT source, prompt, count(*) AS n, list(pred ORDER BY k) AS preds, list(acc ORDER BY k) AS accs, list(reward ORDER BY k) AS rewards FROM a GROUP BY 1, 2),
s AS (SELECT *, unnest(list_append(list_filter([2, 4, 8, 16, 32, 64, 128, 256], lambda x: x < n), n)) AS m FROM g WHERE n > 1),
p AS (SELECT s.*, list_transform(range(m), lambda j: 1 + CAST('0x' || substr(md5('42:' || source || ':' || prompt || ':' || m || ':' || d || ':' || j), 1, 8) AS BIGINT) % n) AS i FROM s, range({DRAWS}) t(d)),
v AS (SELECT *, list_max(list_transform(range(m), lambda j: len(list_filter(i, lambda y: preds[y] = preds[i[j + 1]])) * 10000 - j)) AS b FROM p),
w AS (SELECT source, prompt, m, accs[i[(10000 - b % 10000) % 10000 + 1]] AS acc, rewards[i[(10000 - b % 10000) % 10000 + 1]] AS reward FROM v),
x AS (SELECT source, prompt, m, avg(acc) AS am, stddev_pop(acc) AS ad, avg(reward) AS rm, stddev_pop(reward) AS rd FROM w GROUP BY 1, 2, 3),
maj AS (SELECT source, unnest(['acc', 'acc', 'reward', 'reward']) AS variable, 'maj@' || m || unnest(['/mean', '/std', '/mean', '/std']) AS metric, unnest([am, ad, rm, rd]) AS v FROM x),
r AS (SELECT source, prompt, variable, val, row_number() OVER (PARTITION BY source, prompt, variable ORDER BY val) AS i, count(*) OVER (PARTITION BY source, prompt, variable) AS n FROM (SELECT source, prompt, unnest(['acc', 'reward']) AS variable, unnest([acc, reward]) AS val FROM a)),
e AS (SELECT *, unnest(list_append(list_filter([2, 4, 8, 16, 32, 64, 128, 256], lambda x: x < n), n)) AS m FROM r WHERE n > 1),
q AS (SELECT source, prompt, variable, m, sum(val * ((i / n) ** m - ((i - 1) / n) ** m)) AS b, sum(val * val * ((i / n) ** m - ((i - 1) / n) ** m)) AS b2, sum(val * (((n - i + 1) / n) ** m - ((n - i) / n) ** m)) AS l, sum(val * val * (((n - i + 1) / n) ** m - ((n - i) / n) ** m)) AS l2 FROM e GROUP BY 1, 2, 3, 4),
drawn AS (SELECT source, variable, unnest(['best@', 'best@', 'worst@', 'worst@']) || m || unnest(['/mean', '/std', '/mean', '/std']) AS metric, unnest([b, sqrt(greatest(b2 - b * b, 0)), l, sqrt(greatest(l2 - l * l, 0))]) AS v FROM q),
plain AS (SELECT source, variable, unnest(['mean@' || n, CASE WHEN n > 1 THEN 'std@' || n END]) AS metric, unnest([m, d]) AS v FROM (SELECT source, prompt, variable, count(*) AS n, avg(val) AS m, stddev_pop(val) AS d FROM r GROUP BY 1, 2, 3)),
block AS (SELECT source, variable, metric, avg(v) AS value FROM (SELECT * FROM maj UNION ALL SELECT * FROM drawn UNION ALL SELECT * FROM plain WHERE metric IS NOT NULL) GROUP BY 1, 2, 3)"""


def run_of_answers(spark, sf):
    rows = rollouts(spark, sf).select(F.col("status").alias("source"), F.col("uid").alias("prompt"), "rollout", (F.col("score") > 150000).cast("double").alias("acc"), (F.col("score") / 1000).alias("reward"), F.col("category").alias("pred"))
    return V.validation_block(rows, "source", "prompt", ["acc", "reward"], "rollout", "pred", draws=DRAWS)


@query(f"""WITH {RUN_SQL}, z AS (SELECT *, max(regexp_extract(metric, '@([0-9]+)', 1)::INT) OVER (PARTITION BY source, variable) AS top FROM block)
SELECT CASE WHEN variable = 'acc' AND regexp_matches(metric, '^(mean|maj|best)') AND contains(metric, '@' || top) THEN 'val-core' ELSE 'val-aux' END || '/' || source || '/' || variable || '/' || metric AS name, round(value, 4) AS value FROM z""")
def validation_run(spark, sf):
    return V.named_metrics(run_of_answers(spark, sf), "source").select("name", F.round("value", 4).alias("value"))


@query("""SELECT p_partkey, r::INT AS sample, p_partkey || '#' || r AS sample_id FROM part, range(3) t(r)""")
def repeated_prompts(spark, sf):
    return V.repeated_prompts(table(spark, sf, "part").select("p_partkey"), "p_partkey", 3)


@query("""WITH l AS (SELECT o_custkey AS k, max_by(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'F') AS a, max_by(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'O') AS b FROM orders GROUP BY 1)
SELECT count(*) AS pairs, round(avg(b - a), 3) AS mean, round(avg((b > a)::INT), 6) AS positive, true AS around, true AS wide FROM l WHERE a IS NOT NULL AND b IS NOT NULL""")
def paired_bootstrap(spark, sf):
    rows = rollouts(spark, sf)
    a, b = rows.where("status = 'F'"), rows.where("status = 'O'")
    found = V.paired_bootstrap(a, b, "uid", "score", "rollout")
    from ..operators.joins import paired_difference

    error = paired_difference(a, b, "uid", "score", "rollout").agg((2 * 1.96 * F.stddev_samp("difference") / F.sqrt(F.count("difference"))).alias("_wide"))
    ratio = (F.col("upper") - F.col("lower")) / F.col("_wide")
    return found.join(F.broadcast(error)).select("pairs", F.round("mean", 3).alias("mean"), F.round("positive", 6).alias("positive"), F.col("mean").between(F.col("lower"), F.col("upper")).alias("around"), ratio.between(0.75, 1.25).alias("wide"))
