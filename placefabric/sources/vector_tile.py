"""Vector tile encoding (Mapbox vector tile 2.1) of point features, a protobuf of one layer."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

EXTENT = 4096


def varint(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = n >> 7, n & 0x7F
        out.append(low | 0x80 if n else low)
        if not n:
            return bytes(out)


def block(number: int, body: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(body)) + body


def zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def encode(layer: str, features: list[tuple[int, int, int, dict[str, str]]]) -> bytes:
    """(id, x, y, attributes) -> one layer of points with text attributes."""
    keys: dict[str, int] = {}
    values: dict[str, int] = {}
    body = block(1, layer.encode())
    for number, x, y, attributes in features:
        tags = b"".join(varint(keys.setdefault(k, len(keys))) + varint(values.setdefault(str(v), len(values))) for k, v in attributes.items() if v is not None)
        body += block(2, varint(1 << 3) + varint(number) + block(2, tags) + varint(3 << 3) + varint(1) + block(4, varint(9) + varint(zigzag(x)) + varint(zigzag(y))))
    body += b"".join(block(3, k.encode()) for k in keys) + b"".join(block(4, block(1, v.encode())) for v in values)
    return block(3, body + varint(5 << 3) + varint(EXTENT) + varint(15 << 3) + varint(2))


def tiles(features: DataFrame, layer: str = "places") -> DataFrame:
    """(z, x, y, rn, id, px, py, name, category) -> (z, x, y, tile). A tile has at most its cap of features."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        data = encode(layer, [(int(r.id), int(r.px), int(r.py), {"name": r.name_, "category": r.category}) for r in pdf.itertuples()])
        return pd.DataFrame({"z": [pdf.z.iloc[0]], "x": [pdf.x.iloc[0]], "y": [pdf.y.iloc[0]], "tile": [data]})

    return features.selectExpr("z", "x", "y", "rn", "id", "px", "py", "name as name_", "category").groupBy("z", "x", "y").applyInPandas(one, "z int, x int, y int, tile binary")
