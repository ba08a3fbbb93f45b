"""Economics over measured rates, volumes of orders, and shares of the documents' sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import economics as EC
from ..operators import extract as E
from ..operators import score as S
from .q_extract import V2, docs
from .q_sequence import table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return add


def rounded(df, places, *names):
    return df.withColumns({n: F.round(n, places) for n in names})


RATED = f"{V2},\nq AS (SELECT difficulty, CAST(count(*) AS DOUBLE) AS volume, count(*) FILTER (n_wrong = 0) / CAST(count(*) AS DOUBLE) AS stp FROM s GROUP BY difficulty)"


def rated(spark, d):
    """(difficulty, volume, stp): documents and their straight-through rate under the rules, measured; a row for each difficulty."""
    by = S.score(E.extract(docs(spark, d))).groupBy("difficulty").agg(F.count("*").cast("double").alias("volume"), F.count_if("stp_loose").alias("n"))
    return by.select("difficulty", "volume", (F.col("n") / F.col("volume")).alias("stp"))


@query("exception_economics", f"""WITH {RATED} SELECT difficulty, round(volume * (1 - stp), 6) AS exceptions, round(volume * (1 - stp) * 8.0::DOUBLE / 60, 6) AS hours, round(volume * (1 - stp) * 8.0::DOUBLE / 60 * 45.0::DOUBLE * 12, 4) AS annual,
 round(volume * (1 - stp) * 8.0::DOUBLE / 60 / 152.0::DOUBLE, 6) AS fte FROM q""")
def exception_economics(spark, d):
    """What the documents that the rules do not take straight through cost, by difficulty."""
    out = EC.exceptions(rated(spark, d))
    return rounded(rounded(out, 6, "exceptions", "hours", "fte"), 4, "annual").select("difficulty", "exceptions", "hours", "annual", "fte")


@query("sensitivity", f"""WITH {RATED} SELECT difficulty, minutes, hourly, round(volume * (1 - stp) * minutes / 60 * hourly * 12, 4) AS annual FROM q,
 (SELECT unnest([2.0::DOUBLE, 5.0, 8.0, 15.0, 30.0]) AS minutes), (SELECT unnest([25.0::DOUBLE, 35.0, 45.0, 65.0, 90.0]) AS hourly)""")
def sensitivity(spark, d):
    out = EC.grid(rated(spark, d), (2.0, 5.0, 8.0, 15.0, 30.0), (25.0, 35.0, 45.0, 65.0, 90.0))
    return rounded(out, 4, "annual").select("difficulty", "minutes", "hourly", "annual")


@query("compare_options", f"""WITH {RATED}, b AS (SELECT max(stp) AS better FROM q), z AS (SELECT difficulty, (volume * 0.05::DOUBLE - 4000.0::DOUBLE / 12) * 12 AS infra, volume * (better - stp) * 8.0::DOUBLE / 60 * 45 * 12 AS gain, volume FROM q, b)
 SELECT difficulty, round(infra, 4) AS infra_delta, round(gain, 4) AS stp_delta, round(gain / nullif(infra, 0), 6) + 0.0 AS ratio, round(24000.0::DOUBLE / (volume * 0.01::DOUBLE * 8 / 60 * 45 * 12), 6) AS payback_points FROM z""")
def compare_options(spark, d):
    """What it would save to read every difficulty as well as the best one, beside what hosting saves."""
    rates = rated(spark, d)
    best = rates.agg(F.max("stp").alias("better"))  # one row
    out = EC.options(rates.crossJoin(F.broadcast(best)))
    return rounded(rounded(out, 4, "infra_delta", "stp_delta"), 6, "ratio", "payback_points").select("difficulty", "infra_delta", "stp_delta", "ratio", "payback_points")


VOLUMES = "v AS (SELECT o_orderpriority AS line, CAST(count(*) AS DOUBLE) / count(DISTINCT date_trunc('month', o_orderdate)) AS volume, avg(o_totalprice) / 1000000 AS price FROM orders GROUP BY o_orderpriority)"


def volumes(spark, d):
    """(line, volume, price): orders a month by priority, and a price a call that a millionth of their mean value gives."""
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("line"))
    return o.agg((F.count("*") / F.count_distinct(F.trunc("o_orderdate", "month"))).alias("volume"), (F.avg("o_totalprice") / 1_000_000).alias("price"))


@query("stp_point_value", f"WITH {VOLUMES} SELECT line, round(volume * 0.01::DOUBLE * 8 / 60 * 45, 4) AS monthly, round(volume * 0.01::DOUBLE * 8 / 60 * 45 * 12, 4) AS annual FROM v")
def stp_point_value(spark, d):
    return volumes(spark, d).select("line", F.round(EC.point_value(F.col("volume")) / 12, 4).alias("monthly"), F.round(EC.point_value(F.col("volume")), 4).alias("annual"))


@query("break_even_volume", f"WITH {VOLUMES} SELECT line, round(24000.0::DOUBLE / 12 / price, 2) AS volume FROM v")
def break_even_volume(spark, d):
    return volumes(spark, d).select("line", F.round(EC.break_even(F.col("price")), 2).alias("volume"))


@query("volume_sensitivity", f"""WITH {VOLUMES}, f AS (SELECT line, volume * factor AS volume, factor FROM v, (SELECT unnest([1, 10, 100, 1000]) AS factor))
 SELECT line, factor, round(volume * 12 * 0.05::DOUBLE, 4) AS api, round(volume * 12 * 0.05::DOUBLE - 24000.0::DOUBLE, 4) AS infra_win, round(volume * 0.01::DOUBLE * 8 / 60 * 45 * 12, 4) AS point FROM f""")
def volume_sensitivity(spark, d):
    v = volumes(spark, d).withColumn("factor", F.explode(F.array(*map(F.lit, (1, 10, 100, 1000))))).withColumn("volume", F.col("volume") * F.col("factor"))
    api = F.col("volume") * 12 * EC.X["api_price"]
    return v.select("line", "factor", F.round(api, 4).alias("api"), F.round(api - (EC.X["build"] + EC.X["maintenance"]), 4).alias("infra_win"), F.round(EC.point_value(F.col("volume")), 4).alias("point"))


SHARES = """k AS (SELECT coalesce(lang, '?') AS lang, coalesce(source, '?') AS format, count(*) AS n FROM documents GROUP BY ALL),
 w AS (SELECT lang, CAST(row_number() OVER o AS INTEGER) AS formats, sum(n) OVER o AS total, n FROM k WINDOW o AS (PARTITION BY lang ORDER BY n DESC, format)),
 z AS (SELECT lang, formats, sum(CASE WHEN formats <= 3 THEN n ELSE 0 END) OVER (PARTITION BY lang ORDER BY formats) / CAST(total AS DOUBLE) AS share FROM w)"""
HUMAN = "(100000 * 12 * (1 - {stp}) * ({v} * 1.5::DOUBLE + (1 - {v}) * 8.0::DOUBLE) / 60 * 45)"
YEARS = f"c AS (SELECT lang, formats, formats * 1200 + {HUMAN.format(stp='share', v='0::DOUBLE')} AS rules_year_one, 21000 + {HUMAN.format(stp='0.85::DOUBLE', v='0.15::DOUBLE')} AS model_year_one FROM z)"


def shares(spark, d):
    """The documents' sources as formats, by language: counted, so that the tail is the measured one."""
    counts = table(spark, d, "documents").groupBy(F.coalesce("lang", F.lit("?")).alias("lang"), F.coalesce("source", F.lit("?")).alias("format")).agg(F.count("*").alias("n"))
    return EC.coverage(counts, "lang")


@query("zipf_coverage", f"WITH {SHARES} SELECT lang, formats, round(share, 6) AS covered, round(1 - share, 6) AS tail FROM z")
def zipf_coverage(spark, d):
    return shares(spark, d).select("lang", "formats", F.round("share", 6).alias("covered"), F.round(1 - F.col("share"), 6).alias("tail"))


@query("format_compare", f"WITH {SHARES}, {YEARS} SELECT lang, formats, round(rules_year_one, 2) AS rules_year_one, round(model_year_one, 2) AS model_year_one FROM c")
def format_compare(spark, d):
    return rounded(EC.compared(shares(spark, d)), 2, "rules_year_one", "model_year_one").drop("share")


@query("crossover", f"WITH {SHARES}, {YEARS} SELECT lang, coalesce(min(formats) FILTER (model_year_one < rules_year_one), count(*) + 1) AS formats FROM c GROUP BY lang")
def crossover(spark, d):
    """The first number of formats at which the model costs less in the first year; one more than there are if it never does."""
    c = EC.compared(shares(spark, d))
    return c.groupBy("lang").agg(F.coalesce(F.min(F.when(F.col("model_year_one") < F.col("rules_year_one"), F.col("formats").cast("long"))), F.count("*") + 1).alias("formats"))


@query("onboarding", "SELECT lang, count(DISTINCT coalesce(source, '?')) * 2.0::DOUBLE AS rule_days, count(DISTINCT coalesce(source, '?')) * 1200.0::DOUBLE AS rule_cost, 0.0::DOUBLE AS model_days FROM (SELECT coalesce(lang, '?') AS lang, source FROM documents) GROUP BY lang")
def onboarding(spark, d):
    """What rules for all formats of a language cost; a model needs none."""
    n = table(spark, d, "documents").groupBy(F.coalesce("lang", F.lit("?")).alias("lang")).agg(F.count_distinct(F.coalesce("source", F.lit("?"))).alias("n"))
    return n.select("lang", (F.col("n") * EC.RULES["days_per_format"]).alias("rule_days"), (F.col("n") * EC.RULES["days_per_format"] * EC.RULES["day"]).alias("rule_cost"), F.lit(0.0).alias("model_days"))
