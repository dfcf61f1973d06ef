"""Schemas of the engine's tables, and the products that reports are about."""

from __future__ import annotations

FUELS = ("diesel", "e5", "e10")
LABELS = {"diesel": "Diesel", "e5": "Super E5", "e10": "Super E10"}
REPORT = "id string, date timestamp_ntz, station string, fuel string, price double"
PRICE = "struct<id: string, date: timestamp_ntz, price: double, previousPrice: double, change: double>"
ENTRY = "struct<id: string, date: timestamp_ntz, price: double>"
POINT = "struct<type: string, coordinates: array<double>>"
ADDRESS = "struct<street: string, houseNumber: string, postCode: string, city: string>"
STATION = f"id string, name string, brand string, address {ADDRESS}, location {POINT}, favorite boolean"
PARTIAL_STATION = f"struct<id: string, name: string, brand: string, location: {POINT}, address: struct<postCode: string>>"
DAILY = f"""id string, day timestamp_ntz, fuel string, station {PARTIAL_STATION}, prices array<{PRICE}>,
    openingPrice double, closingPrice double, lowestPrice {ENTRY}, highestPrice {ENTRY}, weightedAveragePrice double"""
STATION_CSV = "uuid string, name string, brand string, street string, house_number string, post_code string, city string, latitude string, longitude string"


def report_csv(fuels=FUELS) -> str:
    """Columns of a report file: per product its price, and whether it changed."""
    return ", ".join(f"{c} string" for c in ("date", "station_uuid", *fuels, *(f"{f}change" for f in fuels)))
