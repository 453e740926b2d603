"""Token weights, price multipliers, turn classes and cache states.

Weights are exact integers: type weights times 20 and multipliers times 5, so
sums do not depend on their order and one division by 100 ends them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 20 times the weight of each token type relative to an input token.
TYPE_WEIGHTS = {"input_tokens": 20, "output_tokens": 100, "cache_read": 2, "cache_create_5m": 25, "cache_create_1h": 40}
#: Five times the multiplier of each priced model; any other counts as 1.0.
MULTIPLIERS = {"m-large": 10, "m-base": 5, "m-mid": 3, "m-small": 1}
DEFAULT = 5


def price_table(spark: SparkSession) -> DataFrame:
    rows = [(m, v / 5, v * 1.0, v * 5.0) for m, v in MULTIPLIERS.items()]
    return spark.createDataFrame(rows, "model string, multiplier double, input_price double, output_price double")


#: Output tokens cost so many times an input token's price, give or take.
RATIO, RATIO_TOLERANCE = 5.0, 0.01


def overridden(prices: DataFrame, own: DataFrame) -> DataFrame:
    """prices (model, multiplier, input_price, output_price) with a user's (model, input_price, output_price, status) in place of theirs; a status of 'unverified' marks a price that was found and awaits a look.

    Multipliers are input prices relative to the dearness of the multiplier 1.
    """
    new = own.select("model", (F.col("input_price") / DEFAULT).alias("multiplier"), "input_price", "output_price", F.coalesce("status", F.lit("")).alias("status"))
    return prices.join(own, "model", "left_anti").withColumn("status", F.lit("")).unionByName(new)


def model_prices(models: DataFrame, prices: DataFrame) -> DataFrame:
    """models (model) with their price; unpriced ones count with the multiplier 1. breaks_ratio: output is not RATIO times input, so one multiplier only comes near; unverified: by overridden()."""
    if "status" not in prices.columns:
        prices = prices.withColumn("status", F.lit(""))
    m = models.join(prices, "model", "left")
    off = (F.col("input_price") > 0) & (F.col("output_price") > 0) & (F.abs(F.col("output_price") / F.col("input_price") - RATIO) > RATIO_TOLERANCE)
    return m.select("model", F.coalesce("multiplier", F.lit(1.0)).alias("multiplier"), "input_price", "output_price", F.col("multiplier").isNotNull().alias("priced"), F.coalesce(off, F.lit(False)).alias("breaks_ratio"), F.coalesce(F.col("status") == "unverified", F.lit(False)).alias("unverified"))


def multiplier5() -> F.Column:
    out = F.lit(DEFAULT)
    for m, v in MULTIPLIERS.items():
        out = F.when(F.col("model") == m, v).otherwise(out)
    return out.cast("bigint")


def raw() -> F.Column:
    return sum((F.col(c) for c in TYPE_WEIGHTS), F.lit(0)).cast("bigint")


def type20() -> F.Column:
    """20 times the type-weighted tokens."""
    return sum((F.col(c) * w for c, w in TYPE_WEIGHTS.items()), F.lit(0)).cast("bigint")


def weighted(turns: DataFrame) -> DataFrame:
    return turns.withColumns({"raw_tokens": raw(), "tw20": type20(), "cw100": type20() * multiplier5()})


def classified(turns: DataFrame) -> DataFrame:
    """idle_miss, rotation, restructure or normal: the first rule that holds."""
    written = F.col("cache_create_5m") + F.col("cache_create_1h")
    total = written + F.col("cache_read")
    kind = (
        F.when(total < 1000, "normal").when((F.col("gap_s") > 300) & (written > 3000), "idle_miss")
        .when((written > 10000) & (F.col("cache_read") < 1000), "rotation").when((written > 10000) & (written * 5 > total), "restructure").otherwise("normal")
    )
    return turns.withColumn("classification", kind)


def cache_state(gap: str = "gap_s") -> F.Column:
    return F.when(F.col(gap) > 3600, "cold").when(F.col(gap) > 300, "warm_1h").otherwise("warm_5m")


def cold_prefix100(ttl_1h: bool = True) -> F.Column:
    """100 times the cost of writing a turn's whole prefix again."""
    return raw() * (40 if ttl_1h else 25) * multiplier5()


def owner() -> F.Column:
    return F.coalesce(F.nullif(F.col("parent_session_uuid"), F.lit("")), F.col("session_uuid"))
