"""Seeded families of business documents: an order, its delivery notes and invoices, with at most one planted defect."""

from __future__ import annotations

import random
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

#: What a family may have wrong, and how often of a hundred.
SCENARIOS = {"clean": 40, "price_changed": 12, "quantity_raised": 12, "short_delivery": 12, "foreign_line": 12, "duplicate_invoice": 12}
GOODS = ["steel pipe", "copper wire", "valve", "bearing", "gasket", "pump", "filter", "relay", "switch", "cable tray"]
LINE = "kind string, doc_id long, number string, scenario string, line int, sku string, description string, quantity decimal(18,4), unit_price decimal(18,4)"


def family(seed: int, order: int) -> Iterator[tuple]:
    """The lines of a family's documents; the same for the same seed and order, wherever they are made."""
    rng = random.Random(f"{seed}/{order}")
    scenario = rng.choices(list(SCENARIOS), weights=list(SCENARIOS.values()))[0]
    codes = rng.sample(range(100, 1000), rng.randint(2, 6))
    lines = [(i + 1, f"SKU-{c}", f"{rng.choice(GOODS)} {c}", rng.randint(2, 40), rng.randint(100, 90_000)) for i, c in enumerate(codes)]
    at = rng.randrange(len(lines))

    def rows(kind: str, doc_id: int, number: str, changed: list[tuple]) -> Iterator[tuple]:
        for nr, sku, description, quantity, cents in changed:
            yield kind, doc_id, number, scenario, nr, sku, description, _decimal(quantity * 100), _decimal(cents)

    def with_line(**new: int | str) -> list[tuple]:
        nr, sku, description, quantity, cents = lines[at]
        own = (nr, new.get("sku", sku), description, quantity + new.get("more", 0), cents + new.get("dearer", 0))
        return [own if i == at else line for i, line in enumerate(lines)]

    billed = {
        "price_changed": lambda: with_line(dearer=max(5, lines[at][4] // 20)), "quantity_raised": lambda: with_line(more=rng.randint(1, 5)), "foreign_line": lambda: with_line(sku=f"SKU-{rng.randint(1000, 9999)}"),
    }.get(scenario, lambda: lines)()
    noted = with_line(more=-1) if scenario == "short_delivery" else billed
    yield from rows("PURCHASE_ORDER", order, f"PO-{order}", lines)
    yield from rows("DELIVERY_NOTE", order, f"DN-{order}", noted)
    yield from rows("INVOICE", order, f"INV-{order}", billed)
    if scenario == "duplicate_invoice":
        yield from rows("INVOICE", -order - 1, f"inv {order}", billed)


def _decimal(cents: int):
    from decimal import Decimal

    return Decimal(cents) / 100


@udtf(returnType=LINE)
class DocumentFamily:
    def eval(self, seed: int, order: int) -> Iterator[tuple]:
        yield from family(seed, order)


def families(spark: SparkSession, orders: DataFrame, seed: int, *columns: str) -> DataFrame:
    """A lateral join: the family's lines beside ``o_orderkey`` and ``columns`` of each order."""
    spark.udtf.register("document_family", DocumentFamily)
    own = ", ".join(f"o.{c}" for c in ("o_orderkey", *columns))
    return spark.sql(f"SELECT {own}, f.* FROM {{orders}} o, LATERAL document_family({int(seed)}, o.o_orderkey) f", orders=orders)
