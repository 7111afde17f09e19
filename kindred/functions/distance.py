"""The five product distances and their weighted blend.

Each function takes the candidate's column first and the query's second; only
the price distance is asymmetric.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions.vectors import dot


@dataclass(frozen=True)
class Weights:
    """Blend weights. They need not sum to one. A zero weight means the
    component is neither read nor computed; the title is always compared."""

    title: float = 0.85
    image: float = 0.15
    product: float = 0.0
    brand: float = 0.0
    price: float = 0.0

    @classmethod
    def of(cls, weights: "Weights | Mapping[str, float] | None") -> "Weights":
        """Accept a mapping with keys ``title`` or ``title_wt`` and so on."""
        if weights is None:
            return cls()
        if isinstance(weights, cls):
            return weights
        renamed = {
            "product" if key.removesuffix("_wt") == "prod" else key.removesuffix("_wt"): value
            for key, value in weights.items()
        }
        return cls(**{f.name: float(renamed.pop(f.name, 0.0)) for f in fields(cls)}, **renamed)

    def vectors(self) -> dict[str, float]:
        """Vector column -> factor f such that the blend contains f * (1 - a.b)."""
        used = {"title_vec": self.title / 2}
        if self.image:
            used["image_vec"] = self.image
        if self.product:
            used["product_vec"] = self.product / 2
        return used

    def columns(self) -> list[str]:
        """Feature columns the blend reads."""
        scalars = [n for n, w in (("brand", self.brand), ("price_hint", self.price)) if w]
        return [*self.vectors(), *scalars]


def title_distance(a: Column, b: Column) -> Column:
    return (1 - dot(a, b)) * 0.5


def image_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b)


def product_distance(a: Column, b: Column) -> Column:
    return (1 - dot(a, b)) * 0.5


def brand_distance(a: Column, b: Column, null_safe: bool = False) -> Column:
    """0 for the same brand, else 1. Two missing brands differ unless ``null_safe``."""
    same = a.eqNullSafe(b) if null_safe else F.coalesce(a == b, F.lit(False))
    return F.when(same, 0.0).otherwise(1.0)


def price_distance(a: Column, b: Column) -> Column:
    """Relative gap; a query up to 10 % dearer than the candidate costs nothing.

    A missing price on either side, or two prices that cancel out, give 0.
    """
    total = a + b
    known = a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b)
    return (
        F.when(known & (total != 0) & (b < a), (a - b) / total)
        .when(known & (total != 0) & (b > 1.1 * a), (b - 1.1 * a) / total)
        .otherwise(0.0)
    )


def blended_distance(
    a: Callable[[str], Column],
    b: Callable[[str], Column],
    weights: Weights | Mapping[str, float] | None = None,
    null_safe_brand: bool = False,
) -> Column:
    """Weighted sum of the used distances; ``a`` and ``b`` look up a side's column."""
    w = Weights.of(weights)
    total = w.title * title_distance(a("title_vec"), b("title_vec"))
    if w.image:
        total = total + w.image * image_distance(a("image_vec"), b("image_vec"))
    if w.product:
        total = total + w.product * product_distance(a("product_vec"), b("product_vec"))
    if w.brand:
        total = total + w.brand * brand_distance(a("brand"), b("brand"), null_safe_brand)
    if w.price:
        total = total + w.price * price_distance(a("price_hint"), b("price_hint"))
    return total


def similarity(distance: Column) -> Column:
    return 1 - distance


def product_rule_distance(
    a_products: Column, a_parents: Column, b_products: Column, b_parents: Column
) -> Column:
    """Rule ladder on product strings, the alternative to product vectors."""
    hit = lambda condition: F.coalesce(condition, F.lit(False))
    return (
        F.when(a_products.isNull() | b_products.isNull(), 0.8)
        .when(a_products == b_products, 0.0)
        .when(hit(a_products == b_parents) | hit(b_products == a_parents), 0.1)
        .when(hit(b_products.contains(a_parents)) | hit(a_products.contains(b_parents)), 0.3)
        .when(b_products.contains(a_products) | a_products.contains(b_products), 0.3)
        .otherwise(1.0)
    )
