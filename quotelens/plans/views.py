"""Domain tables derived from the star-schema tables that the test data ships."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelens import schema as S
from quotelens.functions import quarter_text
from quotelens.operators.baskets import member_rows
from quotelens.operators.rolling import rolling_history
from quotelens.operators.splits import exclude_test, supervised
from quotelens.plans.features import contract_columns, contract_terms, feature_table
from quotelens.session import materialise


class Domain:
    """Quotes, series and dimension over one folder of star-schema parquet files."""

    split_years = S.SplitYears(train_end=1998, validation=1999, test_start=2000)
    members = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.registry = S.FeatureRegistry(self.members)

    def stored(self) -> bool:
        """Whether all views that were written to scratch are still there."""
        for name in ("stored_quotes", "stored_history", "contract_frame", "model_frame"):
            frame = self.__dict__.get(name)
            files = frame.inputFiles() if frame is not None else []
            if files:
                jvm = self.spark._jvm.org.apache.hadoop.fs.Path(files[0])
                if not jvm.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jvm):
                    return False
        return True

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def dimension(self) -> DataFrame:
        part = self.table("part")
        # The total is a one-row aggregate, so it is a scalar subquery rather than a join.
        share = part.groupBy("p_type").agg(F.count(F.lit(1)).alias("_n"))
        total = part.agg(F.count(F.lit(1)).alias("_all"))
        core, mid = ("STANDARD", "PROMO"), ("SMALL", "MEDIUM")
        kind = F.col("p_type")
        return share.select(
            kind.alias("underlying"),
            F.when(kind.isin(*core), "core").when(kind.isin(*mid), "mid").otherwise("tail").alias("sector"),
            (F.col("_n").cast("double") / total.scalar().cast("double")).alias("structural_base_vol"),
        )

    @cached_property
    def _typed_lines(self) -> DataFrame:
        line = self.table("lineitem")
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
        return line.join(part, "l_partkey")

    @cached_property
    def series(self) -> DataFrame:
        cents = F.round(F.col("l_discount") * 100).cast("bigint")
        return (
            self._typed_lines.groupBy(F.col("l_shipdate").cast("date").alias("date"), F.col("p_type").alias("underlying"))
            .agg(F.sum(cents).alias("_cents"), F.count(F.lit(1)).alias("_n"))
            .select(
                "date",
                "underlying",
                (0.05 + F.col("_cents").cast("double") / F.col("_n").cast("double") / 100.0).alias("realized_vol_63d"),
            )
        )

    @cached_property
    def quotes(self) -> DataFrame:
        basket = self._typed_lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
            F.collect_set("p_type").alias("_set"),
            F.sum(F.col("l_quantity").cast("bigint")).alias("_quantity"),
            F.count(F.lit(1)).alias("_lines"),
        )
        nation = self.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
        customer = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")
        order = self.table("orders").join(customer, "o_custkey").join(nation, "c_nationkey").join(basket, "o_orderkey")
        key = F.col("o_orderkey")
        asked = F.col("o_orderdate").cast("date")
        executed = F.col("o_orderstatus") != "P"
        spellings = (
            "1M", "Monthly", "mensual", "M", "1 month", "2M", "3M", "Quarterly", "trimestral",
            "Q", "3 months", "6M", "1Y", "12M", "Annual", "anual", "Y", "1D",
        )
        return order.select(
            key.alias("rfq_id"),
            F.col("o_orderpriority").alias("product_type"),
            F.array_join(F.sort_array("_set"), "|").alias("underlyings"),
            F.when(F.size("_set") == 1, "single").otherwise("worst_of").alias("basket_type"),
            (0.95 + (key % 46).cast("double") / 100.0).alias("autocall_barrier_pct"),
            (0.50 + (key % 36).cast("double") / 100.0).alias("protection_barrier_pct"),
            (key % 7).cast("int").alias("no_call_period_months"),
            F.element_at(F.array(*[F.lit(s) for s in spellings]), (key % 18 + 1).cast("int")).alias("observation_frequency"),
            (0.10 + (key % 50).cast("double") / 100.0).alias("quoted_implied_vol"),
            F.col("o_totalprice").alias("notional_credits"),
            F.col("c_mktsegment").alias("counterparty"),
            F.col("n_name").alias("trader_id"),
            asked.alias("requested_date"),
            executed.alias("executed"),
            F.date_add(asked, (key % 3).cast("int")).alias("start_date"),
            F.date_add(asked, (key % 3 + 365 * (1 + key % 8)).cast("int")).alias("end_date"),
            F.when(executed, 6.0 + F.col("_quantity").cast("double") / F.col("_lines").cast("double")).alias("avg_duration_months"),
        )

    # The same tables with faults planted by key, so that every quality rule has work to do.

    @cached_property
    def dirty_quotes(self) -> DataFrame:
        key = F.col("rfq_id")

        def hit(divisor: int, rest: int = 0):
            return key % divisor == rest

        def patched(name: str, *cases) -> object:
            chain = None
            for condition, value in cases:
                value = F.lit(value) if not hasattr(value, "alias") else value
                chain = F.when(condition, value) if chain is None else chain.when(condition, value)
            return chain.otherwise(F.col(name))

        text = F.col("underlyings")
        return self.quotes.select(
            (key - F.when(hit(97, 1), 1).otherwise(0)).alias("rfq_id"),
            "product_type",
            patched(
                "underlyings",
                (hit(61), F.concat(text, F.lit("| ZZZ |"))),
                (hit(59), F.concat(text, F.lit("|"), F.element_at(F.split(text, r"\|"), 1))),
            ).alias("underlyings"),
            patched("basket_type", (hit(53), "single"), (hit(31), "best_of")).alias("basket_type"),
            patched("autocall_barrier_pct", (hit(47), 3.0)).alias("autocall_barrier_pct"),
            patched("protection_barrier_pct", (hit(43), 0.0), (hit(101), -0.1)).alias("protection_barrier_pct"),
            patched("no_call_period_months", (hit(79), 400), (hit(103), -1)).alias("no_call_period_months"),
            patched("observation_frequency", (hit(71), "every blue moon"), (hit(67), "fortnightly")).alias("observation_frequency"),
            patched("quoted_implied_vol", (hit(41), 2.5)).alias("quoted_implied_vol"),
            patched("notional_credits", (hit(37), 0.0)).alias("notional_credits"),
            patched("counterparty", (hit(29), None)).alias("counterparty"),
            "trader_id",
            "requested_date",
            patched("executed", (hit(23), None)).alias("executed"),
            patched("start_date", (hit(83), F.date_sub("requested_date", 5))).alias("start_date"),
            patched("end_date", (hit(89), F.date_sub("start_date", 1))).alias("end_date"),
            patched("avg_duration_months", (hit(73), None), (hit(107), -1.0)).alias("avg_duration_months"),
        )

    @cached_property
    def dirty_series(self) -> DataFrame:
        day, date = F.dayofmonth("date"), F.col("date")
        return self.series.select(
            F.when(day == 15, F.date_sub(date, 1)).when(F.year(date) >= 1998, F.date_add(date, 30)).otherwise(date).alias("date"),
            F.when(day == 9, None).otherwise(F.col("underlying")).alias("underlying"),
            F.when(day == 7, F.col("realized_vol_63d") + 3.0).when(day == 8, None).otherwise(F.col("realized_vol_63d")).alias("realized_vol_63d"),
        )

    @cached_property
    def dirty_dimension(self) -> DataFrame:
        name, base = F.col("underlying"), F.col("structural_base_vol")
        return self.dimension.select(
            F.when(name == "PROMO", "STANDARD").otherwise(name).alias("underlying"),
            F.when(name == "LARGE", None).otherwise(F.col("sector")).alias("sector"),
            F.when(name == "SMALL", base + 2.0).otherwise(base).alias("structural_base_vol"),
        )

    @cached_property
    def supervised(self) -> DataFrame:
        return supervised(self.quotes, self.split_years)

    @cached_property
    def development(self) -> DataFrame:
        return exclude_test(self.supervised)

    @cached_property
    def history(self) -> DataFrame:
        return rolling_history(self.series)

    @cached_property
    def stored_quotes(self) -> DataFrame:
        """The quote view once on disk: the feature plan reads it three times."""
        return materialise(self.quotes)

    @cached_property
    def stored_history(self) -> DataFrame:
        """The history once on disk: every feature build reads it at least twice."""
        return materialise(self.history)

    @cached_property
    def member_rows(self) -> DataFrame:
        return member_rows(self.stored_quotes, self.stored_history, self.dimension)

    def features(self, *keep: str, quotes: DataFrame | None = None, include_target: bool = True) -> DataFrame:
        return feature_table(
            self.stored_quotes if quotes is None else quotes,
            self.series,
            self.dimension,
            registry=self.registry,
            keep=keep,
            include_target=include_target,
            history=self.stored_history,
        )

    @cached_property
    def contract_frame(self) -> DataFrame:
        """Supervised quotes with contract columns only, stored: enough for the baselines."""
        frame = contract_columns(self.supervised, self.registry).withColumns(contract_terms())
        frame = frame.withColumn("block", quarter_text(F.col("requested_date")))
        return materialise(frame.withColumn("target", F.col(S.TARGET)))

    def _model_rows(self) -> DataFrame:
        """Supervised quotes with every feature, their split, their segment and ``target``.

        Doubles are kept to nine places: sums added in another order then still give equal values,
        so ranks and distinct counts do not depend on the partitioning.
        """
        frame = self.features("split", "segment", quotes=supervised(self.stored_quotes, self.split_years))
        doubles = [f.name for f in frame.schema.fields if f.dataType.typeName() == "double"]
        steady = {c: F.round(F.col(c) * 1.0000000000001, 9) for c in doubles}
        return frame.withColumns(steady).withColumn("target", F.col(S.TARGET))

    @cached_property
    def model_frame(self) -> DataFrame:
        """All columns of the model rows, stored."""
        return materialise(self._model_rows())

    def model_columns(self, *columns: str) -> DataFrame:
        """Some columns of the model rows for a query that needs no others: not stored, so what only the others need is not computed."""
        frame = self.model_frame if "model_frame" in self.__dict__ else self._model_rows()
        return frame.select(*columns)
