"""Recorded answers of marketplaces as a data source of their own, which takes the filters that such a source can judge.

Answers lie in a folder of ranges of ids, range=<low>/, as Parquet. A reader is given the conditions of a query: ids choose
the ranges, which become partitions, and others are never opened; prices, conditions, free shipping and returns are the
marketplace's own filters, noted in its notation and judged while reading. What a marketplace can't judge is left to
Spark. Files are reached by pyarrow's file systems from executors, so any of its stores will do.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from lotwatch.functions.text import fold_spaces, let

FORMAT, SPAN = "recorded_answers", 1000
SCHEMA = "listing_id bigint, title string, price double, currency string, condition string, delivery_cost double, returns_accepted boolean"
# A marketplace's names of conditions; how far back ids are scanned, and beyond the last one known.
CONDITIONS = {"new": "{NEW}", "used": "{USED}", "refurbished": "{CERTIFIED_REFURBISHED|SELLER_REFURBISHED}"}
WINDOW, HEADROOM, NO_LATEST = 2500, 120, 5000


def plain_number(x: float) -> str:
    return f"{x:g}"


def browse_filter(criteria: dict[str, Column]) -> Column:
    """The criteria that a marketplace can judge, in its notation: max_item, currency, condition, free_shipping, returns_required."""
    get = lambda name, kind: criteria.get(name, F.lit(None)).cast(kind)
    limit, condition = get("max_item", "double"), F.lower(F.trim(get("condition", "string")))
    currency = F.coalesce(F.nullif(F.upper(F.trim(get("currency", "string"))), F.lit("")), F.lit("USD"))
    sound = F.when((limit >= 0) & ~F.isnan(limit) & (limit < float("inf")), F.round(limit, 2))
    number = F.regexp_replace(F.format_string("%.2f", sound), r"\.?0+$", "")
    names = F.create_map(*[F.lit(x) for kv in CONDITIONS.items() for x in kv])
    parts = F.array(
        F.when(sound.isNotNull(), F.concat(F.lit("price:[.."), number, F.lit("],priceCurrency:"), currency)), F.concat(F.lit("conditions:"), F.try_element_at(names, condition)),
        F.when(get("free_shipping", "boolean"), "maxDeliveryCost:0"), F.when(get("returns_required", "boolean"), "returnsAccepted:true"),
    )
    return F.array_join(F.filter(parts, lambda p: p.isNotNull()), ",")


def id_window(latest: int | None, start: int | None = None, end: int | None = None, window: int = WINDOW, headroom: int = HEADROOM) -> tuple[int, int]:
    """The first and last id to scan: up to some ids beyond the latest known one, and a window back from there."""
    last = end or (latest + max(0, headroom) if latest is not None else NO_LATEST)
    first = start or max(1, last - max(1, window) + 1)
    return min(first, last), max(first, last)


def matches_query(text: Column, query: str) -> Column:
    """Does a folded text hold one of the comma-separated terms, in any place?"""
    from lotwatch.functions.folding import plain

    terms = [" ".join(plain(t, "NFKD").lower().split()) for t in query.split(",") if t.strip()]
    return let(fold_spaces(text), lambda t: F.exists(F.array(*map(F.lit, terms)), lambda x: F.contains(t, x)) if terms else F.lit(False))


def record(listings: DataFrame, path: str, span: int = SPAN) -> None:
    """Write listings as recorded answers, a folder for each range of `span` ids."""
    low = (F.floor(F.col("listing_id") / span) * span).alias("range")
    listings.select(*[f.split(" ")[0] for f in SCHEMA.split(", ")], low).repartition("range").write.partitionBy("range").mode("overwrite").parquet(path)


@dataclass
class Range(InputPartition):
    low: int
    files: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        super().__init__(self.low)


class Reader(DataSourceReader):
    def __init__(self, path: str, span: int) -> None:
        self.path, self.span = path, span
        self.lowest: int | None = None
        self.highest: int | None = None
        self.ids: set[int] | None = None
        self.judged: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not self._taken(f):
                yield f

    def _taken(self, f: Filter) -> bool:
        """Keep a filter for reading if a marketplace could judge it."""
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
        if name == "listing_id" and isinstance(f, In):
            values = {int(v) for v in f.value if v is not None}
            self.ids = values if self.ids is None else self.ids & values
        elif name == "listing_id" and isinstance(f, (EqualTo, LessThan, LessThanOrEqual, GreaterThan, GreaterThanOrEqual)):
            v = int(f.value)
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                v_low = v + isinstance(f, GreaterThan)
                self.lowest = v_low if self.lowest is None else max(self.lowest, v_low)
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                v_high = v - isinstance(f, LessThan)
                self.highest = v_high if self.highest is None else min(self.highest, v_high)
        elif name == "price" and isinstance(f, LessThanOrEqual):
            self.judged.append(("price", "<=", float(f.value)))
        elif name in ("currency", "condition", "returns_accepted", "delivery_cost") and isinstance(f, EqualTo) and (name != "delivery_cost" or f.value == 0):
            self.judged.append((name, "==", f.value))
        else:
            return False
        return True

    def notation(self) -> str:
        """The filters as the marketplace would be sent them."""
        said = {"price": lambda v: f"price:[..{plain_number(v)}]", "currency": lambda v: f"priceCurrency:{v}", "condition": lambda v: f"conditions:{CONDITIONS.get(str(v).lower(), v)}", "delivery_cost": lambda v: "maxDeliveryCost:0", "returns_accepted": lambda v: f"returnsAccepted:{str(v).lower()}"}
        return ",".join(said[name](value) for name, _, value in self.judged)

    def partitions(self) -> list[Range]:
        """A partition for each range of ids that a row asked for may be in."""
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        found = []
        for folder in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if folder.type != fs.FileType.Directory or not folder.base_name.startswith("range="):
                continue
            low = int(folder.base_name.removeprefix("range="))
            inside = (self.lowest is None or low + self.span > self.lowest) and (self.highest is None or low <= self.highest) and (self.ids is None or any(low <= i < low + self.span for i in self.ids))
            if inside:
                files = [f.path for f in store.get_file_info(fs.FileSelector(folder.path)) if f.base_name.endswith(".parquet")]
                found.append(Range(low, sorted(files)))
        # A query that no range can answer reads one partition of nothing.
        return sorted(found, key=lambda r: r.low) or [Range(-1)]

    def read(self, partition: Range) -> Iterator:
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        columns = [f.split(" ")[0] for f in SCHEMA.split(", ")]
        for file in partition.files:
            with store.open_input_file(file) as f:
                for batch in pq.ParquetFile(f).iter_batches(columns=columns):
                    keep = None
                    tests = [(name, pc.less_equal if op == "<=" else pc.equal, value) for name, op, value in self.judged]
                    tests += [("listing_id", pc.greater_equal, self.lowest)] * (self.lowest is not None) + [("listing_id", pc.less_equal, self.highest)] * (self.highest is not None)
                    for name, test, value in tests:
                        one = test(batch[name], value)
                        keep = one if keep is None else pc.and_kleene(keep, one)
                    if self.ids is not None:
                        one = pc.is_in(batch["listing_id"], value_set=_ids(self.ids))
                        keep = one if keep is None else pc.and_kleene(keep, one)
                    yield batch if keep is None else batch.filter(keep)


def _ids(ids: set[int]):
    import pyarrow as pa

    return pa.array(sorted(ids), pa.int64())


class RecordedAnswers(DataSource):
    """Options: path (with its scheme), span (ids of a range)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("span", SPAN)))


def recorded(spark: SparkSession, path: str, span: int = SPAN) -> DataFrame:
    """Recorded answers at a path; filters on them reach the source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordedAnswers)
    return spark.read.format(FORMAT).option("path", path if "://" in path or path.startswith("file:") else f"file://{path}").option("span", span).load()
