"""GeoPackage files: read from any store that Spark reads, written as bytes.

A file is an SQLite database. Spark reads its bytes, a worker opens them in memory and runs one
SELECT that holds the region filter and, where the file has a spatial index, the box. One task a file.
"""

from __future__ import annotations

import json
import re
import sqlite3
import struct
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

READ_SCHEMA = "file string, fid long, properties map<string,string>, geometry array<array<array<array<double>>>>"


def quoted(name: str) -> str:
    """A checked and quoted SQL identifier."""
    if not re.fullmatch(r"[A-Za-z0-9_]+", name):
        raise ValueError(f"not a plain identifier: {name!r}")
    return f'"{name}"'


def wkb(parts: Sequence) -> bytes:
    """A multipolygon as little-endian well-known binary."""
    out = struct.pack("<BII", 1, 6, len(parts))
    for rings in parts:
        out += struct.pack("<BII", 1, 3, len(rings))
        for ring in rings:
            out += struct.pack("<I", len(ring)) + b"".join(struct.pack("<dd", float(p[0]), float(p[1])) for p in ring)
    return out


def blob(parts: Sequence) -> bytes:
    """A GeoPackage geometry: header with envelope, then the binary."""
    points = [p for rings in parts for ring in rings for p in ring]
    if not points:
        return b"GP\x00\x11" + struct.pack("<i", 4326) + wkb(parts)
    xs, ys = [float(p[0]) for p in points], [float(p[1]) for p in points]
    return b"GP\x00\x03" + struct.pack("<i4d", 4326, min(xs), max(xs), min(ys), max(ys)) + wkb(parts)


def parse_wkb(b: bytes, at: int = 0) -> tuple[list, int]:
    """Polygon parts of a polygon, multipolygon or collection; other kinds give none."""
    order = "<" if b[at] else ">"
    kind = struct.unpack_from(order + "I", b, at + 1)[0]
    size = 2 + ((kind & 0x80000000 != 0) + (kind & 0x40000000 != 0) or (0, 1, 1, 2)[min(kind % 0x20000000 // 1000, 3)])
    kind = kind & 0xFFFF
    kind %= 1000
    at += 5
    if kind == 1:
        return [], at + 8 * size
    n = struct.unpack_from(order + "I", b, at)[0]
    at += 4
    if kind == 2:
        return [], at + 8 * size * n
    if kind == 3:
        rings = []
        for _ in range(n):
            m = struct.unpack_from(order + "I", b, at)[0]
            values = struct.unpack_from(f"{order}{m * size}d", b, at + 4)
            rings.append([[values[i], values[i + 1]] for i in range(0, m * size, size)])
            at += 4 + 8 * m * size
        return [rings], at
    parts = []
    for _ in range(n):
        more, at = parse_wkb(b, at)
        parts += more
    return parts, at


def parse_blob(b: bytes | None) -> list:
    if not b or b[:2] != b"GP":
        return []
    return parse_wkb(b, 8 + (0, 32, 48, 48, 64)[min(b[3] >> 1 & 7, 4)])[0]


def feature_table(con: sqlite3.Connection, table: str | None) -> tuple[str, str]:
    """(table, geometry column): the named feature table, else the only one."""
    rows = con.execute("SELECT table_name, column_name FROM gpkg_geometry_columns").fetchall()
    if table is None and len(rows) != 1:
        raise ValueError(f"name one of the tables: {', '.join(t for t, _ in rows)}")
    found = [r for r in rows if table is None or r[0] == table]
    if not found:
        raise ValueError(f"no feature table {table}")
    return found[0]


def select_rows(content: bytes, table: str | None, filter_column: str | None, region: str | None, box: Sequence[float] | None) -> Iterator[tuple]:
    """(fid, properties, parts) of a file's features; blobs are null, all other values text."""
    con = sqlite3.connect(":memory:")
    con.deserialize(content)
    name, geom = feature_table(con, table)
    info = con.execute(f"PRAGMA table_info({quoted(name)})").fetchall()
    key = next((c[1] for c in info if c[5]), None)
    where, values = [], []
    if filter_column and region is not None:
        where.append(f"{quoted(filter_column)} = ?")
        values.append(region)
    index = con.execute("SELECT 1 FROM sqlite_master WHERE name = ?", (f"rtree_{name}_{geom}",)).fetchone()
    if box is not None and index and key:  # without an index the box is not applied
        where.append(f"{quoted(key)} IN (SELECT id FROM {quoted(f'rtree_{name}_{geom}')} WHERE maxx >= ? AND minx <= ? AND maxy >= ? AND miny <= ?)")
        values += [box[0], box[2], box[1], box[3]]
    sql = f"SELECT {quoted(key) if key else 'rowid'}, * FROM {quoted(name)}" + (" WHERE " + " AND ".join(where) if where else "")
    names = [c[1] for c in info]
    for row in con.execute(sql, values):
        cells = dict(zip(names, row[1:]))
        parts = parse_blob(cells.pop(geom))
        yield row[0], {k: None if v is None or isinstance(v, bytes) else str(v) for k, v in cells.items()}, parts


def read(files: DataFrame, table: str | None = None, filter_column: str | None = None, region: str | None = None, box: Sequence[float] | None = None) -> DataFrame:
    """Features of files (file, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, *r) for f, c in zip(b["file"], b["content"]) for r in select_rows(bytes(c), table, filter_column, region, box)]
            yield pd.DataFrame(rows, columns=["file", "fid", "properties", "geometry"])

    return files.select("file", "content").mapInPandas(run, READ_SCHEMA)


def load(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of GeoPackage files in any store."""
    return spark.read.format("binaryFile").load(path).selectExpr("path AS file", "content")


def sanitized(name: str) -> str:
    out = re.sub(r"[^A-Za-z0-9_]", "_", name)
    return "c_" + out if out[:1].isdigit() or not out else out


def file_bytes(rows: list[tuple[dict, Sequence]], table: str, index: Sequence[str] = ()) -> bytes:
    """A GeoPackage with the union of all properties, an R-tree and indexes on the named columns."""
    names: dict[str, str] = {}
    for props, _ in rows:
        for k in props:
            column = sanitized(k)
            if column.lower() not in (x.lower() for x in names.values()):
                names.setdefault(k, column)
    con = sqlite3.connect(":memory:")
    t = quoted(table)
    con.executescript(f"""
      PRAGMA application_id = 1196444487; PRAGMA user_version = 10300;
      CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER, definition TEXT, description TEXT);
      INSERT INTO gpkg_spatial_ref_sys VALUES ('WGS 84', 4326, 'EPSG', 4326, 'undefined', NULL);
      CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, srs_id INTEGER);
      CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INTEGER, m INTEGER);
      INSERT INTO gpkg_contents VALUES ('{table}', 'features', '{table}', 4326);
      INSERT INTO gpkg_geometry_columns VALUES ('{table}', 'geom', 'MULTIPOLYGON', 4326, 0, 0);
      CREATE TABLE {t} (fid INTEGER PRIMARY KEY, geom BLOB{''.join(f', {quoted(c)}' for c in names.values())});
      CREATE VIRTUAL TABLE {quoted(f'rtree_{table}_geom')} USING rtree(id, minx, maxx, miny, maxy);
    """)
    plain = lambda v: int(v) if isinstance(v, bool) else json.dumps(v) if isinstance(v, (dict, list)) else v
    with con:
        for i, (props, parts) in enumerate(rows, 1):
            con.execute(f"INSERT INTO {t} VALUES ({', '.join('?' * (2 + len(names)))})", (i, blob(parts), *[plain(props.get(k)) for k in names]))
            points = [p for rings in parts for ring in rings for p in ring]
            if points:
                xs, ys = [p[0] for p in points], [p[1] for p in points]
                con.execute(f"INSERT INTO {quoted(f'rtree_{table}_geom')} VALUES (?, ?, ?, ?, ?)", (i, min(xs), max(xs), min(ys), max(ys)))
        for c in dict.fromkeys(sanitized(x) for x in index):
            con.execute(f"CREATE INDEX {quoted(f'idx_{table}_{c}')} ON {t} ({quoted(c)})")
    return con.serialize()


def write(features: DataFrame, key: str, table: str, index: Sequence[str] = ()) -> DataFrame:
    """(file, content): one GeoPackage for each value of `key` from (key, id, properties, geometry)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values("id")
        data = [(dict(p), [[[list(q) for q in r] for r in rings] for rings in g]) for p, g in zip(ordered["properties"], ordered["geometry"])]
        return pd.DataFrame({"file": [str(rows[key].iloc[0])], "content": [file_bytes(data, table, index)]})

    return features.groupBy(key).applyInPandas(run, "file string, content binary")
