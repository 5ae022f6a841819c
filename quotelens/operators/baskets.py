"""Quote-to-member expansion and the per-quote aggregates built from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens import schema as S
from quotelens.functions import parse_basket
from quotelens.operators.asof import asof_join
from quotelens.operators.rolling import HISTORY_COLUMNS
from quotelens.session import materialise


def explode_basket(quotes: DataFrame, *carry: str, id_column: str = S.ID) -> DataFrame:
    """One row per (quote, member) with the member's place in the basket."""
    return quotes.select(
        id_column, *carry, F.posexplode(parse_basket(F.col("underlyings"))).alias("position", "underlying")
    )


def join_dimension(members: DataFrame, dimension: DataFrame) -> DataFrame:
    return members.join(
        dimension.select("underlying", "sector", "structural_base_vol"), "underlying", "left"
    )


def member_rows(quotes: DataFrame, history: DataFrame, dimension: DataFrame, id_column: str = S.ID) -> DataFrame:
    """Members with dimension attributes and the history known on the request date."""
    exploded = explode_basket(quotes, "requested_date", id_column=id_column)
    dated = asof_join(
        exploded,
        history,
        by="underlying",
        left_time="requested_date",
        history_time="date",
        values=HISTORY_COLUMNS,
    )
    return join_dimension(dated, dimension)


def _ranked(measure: str, *needed: str) -> tuple[Column, Column, Column, Column]:
    """(highest, second, lowest) member and the highest row, ties in basket order.

    The array is one basket, so its length is set by one input string, never by the group count.
    """
    usable = F.filter(
        F.col("_basket"),
        lambda m: _all_present(m, (measure, *needed)),
    )
    down = F.sort_array(
        F.transform(
            usable,
            lambda m: F.struct(m[measure].alias("v"), (-m["position"]).alias("p"), m["underlying"].alias("u"), m["sector"].alias("s")),
        ),
        asc=False,
    )
    up = F.array_min(
        F.transform(usable, lambda m: F.struct(m[measure].alias("v"), m["position"].alias("p"), m["underlying"].alias("u")))
    )
    first = F.try_element_at(down, F.lit(1))
    second = F.try_element_at(down, F.lit(2))
    return first["u"], second["u"], up["u"], first["s"]


def _all_present(member: Column, names: tuple[str, ...]) -> Column:
    present = member[names[0]].isNotNull()
    for name in names[1:]:
        present = present & member[name].isNotNull()
    return present


def _second_highest(measure: str) -> Column:
    values = F.filter(F.transform(F.col("_basket"), lambda m: m[measure]), lambda v: v.isNotNull())
    return F.try_element_at(F.sort_array(values, asc=False), F.lit(2))


_BASKET_FIELDS = ("position", "underlying", "sector", "structural_base_vol", "realized_vol_63d")


def aggregate_members(members: DataFrame, *keys: str) -> DataFrame:
    """Every aggregate per quote, or per other ``keys``, in one grouping, hence one shuffle of the member rows."""
    spread = {
        "basket_realized_vol_21d": "realized_vol_63d_21d_mean",
        "basket_realized_vol_126d": "realized_vol_63d_126d_mean",
        "basket_realized_vol_trend": "realized_vol_63d_trend_21d_126d",
        "basket_realized_vol_zscore": "realized_vol_63d_zscore_126d",
        "basket_realized_vol_change_21d": "realized_vol_63d_change_21d",
    }
    grouped = members.groupBy(*(keys or [S.ID])).agg(
        *[
            getattr(F, how)(measure).alias(f"{measure}_{how if how != 'avg' else 'mean'}")
            for measure in ("structural_base_vol", "realized_vol_63d")
            for how in ("avg", "min", "max")
        ],
        *[F.avg(source).alias(f"{name}_mean") for name, source in spread.items()],
        *[F.max(source).alias(f"{name}_max") for name, source in spread.items()],
        F.collect_list(F.struct(*_BASKET_FIELDS)).alias("_basket"),
    )
    return _describe_basket(grouped).drop("_basket", "_sectors", "_modal")


def with_aggregates(quotes: DataFrame, history: DataFrame, dimension: DataFrame) -> DataFrame:
    """Quotes with their basket's aggregates; nulls where a quote has no id or no members.

    The aggregates of a quote rest on its basket text and request date alone, so only distinct pairs of these
    are expanded into members, and neither members nor their history move by quote. Quotes that share an
    id share one basket, so these few are expanded and grouped by id.
    """
    ids = quotes.where(F.col(S.ID).isNotNull()).groupBy(S.ID).agg(F.count(F.lit(1)).alias("_n"))
    # Stored, so that its size is known and usually nothing is left to join.
    repeated = materialise(ids.where("_n > 1").select(S.ID))
    shared = repeated.head() is not None
    own = quotes.join(repeated, S.ID, "left_anti") if shared else quotes
    pair = ["underlyings", "requested_date"]
    kinds = own.where(F.col(S.ID).isNotNull()).select(*pair).distinct()
    aggregates = aggregate_members(member_rows(kinds, history, dimension, "underlyings"), *pair)
    values = [c for c in aggregates.columns if c not in pair]
    known = aggregates.select(F.col("underlyings").alias("_basket_text"), F.col("requested_date").alias("_basket_date"), *values)
    same = F.when(F.col(S.ID).isNotNull(), F.col("underlyings")) == F.col("_basket_text")
    done = own.join(known, same & F.col("requested_date").eqNullSafe(F.col("_basket_date")), "left").select(*quotes.columns, *values)
    if not shared:
        return done
    several = quotes.join(repeated, S.ID, "left_semi")
    return done.unionByName(several.join(aggregate_members(member_rows(several, history, dimension)), S.ID, "left"))


def _describe_basket(grouped: DataFrame) -> DataFrame:
    sectors = F.filter(F.transform(F.col("_basket"), lambda m: m["sector"]), lambda s: s.isNotNull())
    grouped = grouped.withColumn("_sectors", sectors)
    # Most frequent sector, the alphabetically first on a tie.
    modal = F.array_min(
        F.transform(
            F.array_distinct("_sectors"),
            lambda s: F.struct((-F.size(F.filter(F.col("_sectors"), lambda o: o == s))).alias("c"), s.alias("s")),
        )
    )
    grouped = grouped.withColumn("_modal", modal)
    top, second, low, top_sector = _ranked("structural_base_vol", "sector")
    realized_top, realized_second, realized_low, _ = _ranked("realized_vol_63d")

    def known(column: Column) -> Column:
        return F.coalesce(column, F.lit(S.UNKNOWN))

    return grouped.withColumns(
        {
            "structural_base_vol_second_highest": _second_highest("structural_base_vol"),
            "structural_base_vol_range": F.col("structural_base_vol_max") - F.col("structural_base_vol_min"),
            "realized_vol_63d_second_highest": _second_highest("realized_vol_63d"),
            "realized_vol_63d_range": F.col("realized_vol_63d_max") - F.col("realized_vol_63d_min"),
            "sector_count": F.size(F.array_distinct("_sectors")),
            "dominant_sector_count": F.coalesce(-F.col("_modal.c"), F.lit(0)),
            "dominant_sector": known(F.col("_modal.s")),
            "highest_vol_sector": known(top_sector),
            "highest_structural_vol_underlying": known(top),
            "second_highest_structural_vol_underlying": known(second),
            "lowest_structural_vol_underlying": known(low),
            "highest_realized_vol_underlying": known(realized_top),
            "second_highest_realized_vol_underlying": known(realized_second),
            "lowest_realized_vol_underlying": known(realized_low),
        }
    )
