"""What a raw table holds: column profiles, a suggested mapping to canonical fields, capabilities, validation."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.cleaning import DATE_STYLES, parse_date

#: Canonical fields with their kind and the headers that mean them; capabilities and the fields they need.
FIELDS = {
    "invoice_id": ("text", ("invoice", "invoiceno", "invoiceid", "orderid", "ordernumber", "transactionid")),
    "occurred_at": ("datetime", ("invoicedate", "date", "orderdate", "datetime", "timestamp", "occurredat")),
    "product_code": ("text", ("stockcode", "sku", "productcode", "productid", "itemcode")),
    "product_name": ("text", ("description", "productname", "product", "itemname")),
    "category": ("text", ("category", "productcategory", "department")),
    "customer_id": ("text", ("customerid", "customer", "clientid", "customerno")),
    "region": ("text", ("country", "region", "state", "city")),
    "quantity": ("numeric", ("quantity", "qty", "units")),
    "unit_price": ("numeric", ("price", "unitprice", "priceeach")),
    "revenue": ("numeric", ("revenue", "amount", "total", "sales", "linetotal")),
    "discount": ("numeric", ("discount", "discountrate")),
}
CAPABILITIES = {
    "sales": (("occurred_at",), (("revenue",), ("quantity", "unit_price"))),
    "products": (("product_code",), ()),
    "categories": (("category",), ()),
    "regions": (("region",), ()),
    "customers": (("customer_id", "invoice_id"), ()),
    "baskets": (("invoice_id", "product_code"), ()),
    "forecast": (("occurred_at",), (("revenue",), ("quantity", "unit_price"))),
    "prices": (("unit_price", "quantity"), ()),
    "promotions": (("discount",), ()),
}


class MappingError(ValueError):
    """A mapping that cannot be used; code says why."""

    def __init__(self, code: str, detail: str):
        super().__init__(f"{code}: {detail}")
        self.code = code


def normalise_header(name: str) -> str:
    return re.sub("[^a-z0-9]", "", name.lower())


def profile(raw: DataFrame, rows: int = 5_000, least: float = 0.95) -> DataFrame:
    """By column: kind (datetime, numeric, text), nulls, distinct values, and the date styles that read it; over the first rows, in one pass."""
    head = raw.limit(rows)
    parts = []
    for c in raw.columns:
        v = F.trim(F.col(f"`{c}`"))
        known = F.when(v != "", v)
        number = F.expr(f"try_cast(replace(trim(`{c}`), ',', '') as double)")
        styles = [F.avg(F.when(known.isNotNull(), parse_date(v, s).isNotNull().cast("int"))).alias(s) for s in DATE_STYLES]
        parts.append(F.struct(
            F.lit(c).alias("column"), F.count_if(known.isNull()).alias("nulls"), F.count_distinct(known).alias("distinct"),
            F.avg(F.when(known.isNotNull(), number.isNotNull().cast("int"))).alias("numeric"), *styles))
    out = head.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")
    fits = F.filter(F.array(*[F.when(F.col(s) >= least, F.lit(s)) for s in DATE_STYLES]), lambda x: x.isNotNull())
    kind = F.when(F.size("styles") > 0, "datetime").when(F.col("numeric") >= least, "numeric").otherwise("text")
    return out.withColumn("styles", fits).select("column", kind.alias("kind"), "nulls", "distinct", "styles", (F.array_contains("styles", "dmy") & F.array_contains("styles", "mdy")).alias("ambiguous"))


def suggest(kinds: Mapping[str, str]) -> tuple[dict[str, str], list[str]]:
    """Canonical field -> column for each field whose headers name a free column of its kind, and the fields whose kind differs."""
    used, mapping, differing = set(), {}, []
    for field, (kind, headers) in FIELDS.items():
        for column in kinds:
            if column not in used and normalise_header(column) in headers:
                if kind != "text" and kinds[column] != kind:
                    differing.append(field)
                else:
                    mapping[field] = column
                    used.add(column)
                break
    return mapping, differing


def capabilities(mapping: Mapping[str, str]) -> dict[str, bool]:
    return {
        name: all(f in mapping for f in every) and (not groups or any(all(f in mapping for f in g) for g in groups))
        for name, (every, groups) in CAPABILITIES.items()
    }


def validate(mapping: Mapping[str, str | None], columns: Sequence[str]) -> dict[str, str]:
    """The mapping without empty entries, or a MappingError."""
    chosen = {k: v for k, v in mapping.items() if v}
    for field, column in chosen.items():
        if field not in FIELDS:
            raise MappingError("UNKNOWN_FIELD", field)
        if column not in columns:
            raise MappingError("UNKNOWN_COLUMN", column)
    if len(set(chosen.values())) < len(chosen):
        raise MappingError("COLUMN_USED_TWICE", ", ".join(sorted(chosen.values())))
    if not capabilities(chosen)["sales"]:
        raise MappingError("MISSING_FIELDS", "a date, and revenue or quantity with price, are needed")
    return chosen


def date_style(raw: DataFrame, column: str, requested: str | None = None, least: float = 0.95) -> str:
    """The requested style if it reads enough of all values, else the only one that does."""
    value = F.trim(F.col(f"`{column}`"))
    known = raw.select(value.alias("v")).where("v <> ''")
    rates = known.agg(*[F.avg(parse_date(F.col("v"), s).isNotNull().cast("int")).alias(s) for s in DATE_STYLES]).first().asDict()
    good = [s for s, r in rates.items() if (r or 0) >= least]
    if requested:
        if requested not in good:
            raise MappingError("DATE_FORMAT", requested)
        return requested
    if len(good) != 1:
        raise MappingError("AMBIGUOUS_DATES" if good else "DATE_FORMAT", ", ".join(good) or column)
    return good[0]


def check_preview(raw: DataFrame, most: int = 200) -> None:
    """Refuse a table without columns or rows, or with more columns than a sales table has."""
    if not raw.columns or raw.isEmpty():
        raise MappingError("EMPTY_FILE", "a header and a row of data are needed")
    if len(raw.columns) > most:
        raise MappingError("MALFORMED_CSV", f"{len(raw.columns)} columns, more than {most}; is it separated by commas?")


def prepared(raw: DataFrame, mapping: Mapping[str, str | None] | None = None, style: str | None = None) -> tuple[dict[str, str], str]:
    """The mapping (suggested where none is given) and the date style that cleaning needs, or a MappingError that says what is missing."""
    check_preview(raw)
    chosen = validate(suggest({r["column"]: r["kind"] for r in profile(raw).collect()})[0] if mapping is None else mapping, raw.columns)
    return chosen, date_style(raw, chosen["occurred_at"], style)
