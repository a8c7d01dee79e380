"""The faceted search: text, sets and ranges, the best variant of each product, total order, pages."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.numbers import within
from millrace.functions.text import natural_key

#: Sort name: (column, descending, text).
SORTS = {
    "lowest_unit_price": ("unit_price", False, False), "highest_unit_price": ("unit_price", True, False),
    "lowest_price": ("price", False, False), "highest_price": ("price", True, False),
    "lowest_potency": ("potency", False, False), "highest_potency": ("potency", True, False),
    "name_az": ("name", False, True), "name_za": ("name", True, True),
    "vendor_az": ("vendor", False, True), "vendor_za": ("vendor", True, True),
}
DEFAULT_SORT, DEFAULT_LIMIT, MOST_LIMIT = "lowest_unit_price", 120, 500


@dataclass(frozen=True)
class Request:
    """A search. Ranges are (low, high), None for open."""

    text: str = ""
    vendors: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    grams: tuple[float | None, float | None] = (None, None)
    price: tuple[float | None, float | None] = (None, None)
    unit_price: tuple[float | None, float | None] = (None, None)
    potency: tuple[float | None, float | None] = (None, None)
    sort: str = DEFAULT_SORT
    offset: int = 0
    limit: int = DEFAULT_LIMIT
    known_categories: tuple[str, ...] = field(default=(), repr=False)

    def normalised(self) -> Request:
        """Unknown sorts and categories dropped, pages within bounds."""
        categories = tuple(c for c in self.categories if not self.known_categories or c in self.known_categories)
        return replace(self, categories=categories, sort=self.sort if self.sort in SORTS else DEFAULT_SORT, offset=max(0, int(self.offset)), limit=min(MOST_LIMIT, max(1, int(self.limit))))

    def identity(self) -> str:
        """Equal for all pages of one search."""
        r = self.normalised()
        return repr((r.text, sorted(set(r.vendors)), sorted(set(r.categories)), r.grams, r.price, r.unit_price, r.potency, r.sort))


def variant_rank(unit_price: str = "unit_price", price: str = "price", grams: str = "grams", identity: str = "variant_id") -> Column:
    """Smallest is best: unit price, price, grams, id; missing numbers count as infinite."""
    last = F.lit(float("inf"))
    return F.struct(F.coalesce(F.col(unit_price), last).alias("a"), F.coalesce(F.col(price), last).alias("b"), F.coalesce(F.col(grams), last).alias("c"), F.col(identity).alias("d"))


def choose(variants: DataFrame, request: Request, product: str = "product_id") -> DataFrame:
    """Each product's best variant among those in the range of grams.

    Price ranges test the chosen variant and never change the choice, so they come after this aggregation and must not
    be pushed below it.
    """
    rows = variants.where(within(F.col("grams"), *request.grams))
    chosen = rows.groupBy(product).agg(F.min_by(F.struct("variant_id", "grams", "price", "unit_price"), variant_rank()).alias("v"), F.count("*").alias("sizes"))
    return chosen.select(product, "v.*", "sizes").where(within(F.col("price"), *request.price) & within(F.col("unit_price"), *request.unit_price))


def order(request: Request, product: str = "product_id") -> list[Column]:
    """Total order: missing numbers count as infinite; ties by product, then variant, rising."""
    name, down, text = SORTS[request.sort]
    key = natural_key(name) if text else F.col(name)
    return [key.desc_nulls_first() if down else key.asc_nulls_last(), F.col(product).asc(), F.col("variant_id").asc()]


def search(products: DataFrame, variants: DataFrame, request: Request, product: str = "product_id") -> DataFrame:
    """All matches with their chosen variant. products: (product_id, name, vendor, category, potency, search_text)."""
    request = request.normalised()
    keep = F.lit(True)
    if request.text:
        keep = keep & F.col("search_text").contains(request.text)
    if request.vendors:
        keep = keep & F.col("vendor").isin(list(request.vendors))
    if request.categories:
        keep = keep & F.col("category").isin(list(request.categories))
    keep = keep & within(F.col("potency"), *request.potency)
    return products.where(keep).join(choose(variants, request, product), product)


def page(matches: DataFrame, request: Request, product: str = "product_id") -> DataFrame:
    """The page's rows in order; Spark takes the first offset + limit rows of each partition and no more."""
    request = request.normalised()
    return matches.orderBy(*order(request, product)).offset(request.offset).limit(request.limit)


def next_offset(total: int, request: Request) -> int | None:
    r = request.normalised()
    end = min(r.offset, total) + r.limit
    return end if end < total else None
