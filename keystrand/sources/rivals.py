"""Second implementations of the store contract, to compare results with.  Missing packages raise when one is opened."""

from __future__ import annotations

from pyspark.sql import DataFrame


class DuckStore:
    """The contract on an embedded SQL engine: small data, one process; requests and rows are collected by the driver."""

    def __init__(self, path: str = ":memory:"):
        try:
            import duckdb
        except ImportError as e:
            raise RuntimeError("this backend needs the duckdb package") from e
        self.db = duckdb.connect(path)
        self.db.execute("CREATE TABLE IF NOT EXISTS kv (key BLOB PRIMARY KEY, value BLOB)")

    def get(self, key: bytes) -> bytes | None:
        row = self.db.execute("SELECT value FROM kv WHERE key = ?", [key]).fetchone()
        return row and row[0]

    def insert(self, key: bytes, value: bytes) -> bool:
        if value == b"\xff" * 8 or self.get(key) is not None:
            return False
        self.db.execute("INSERT INTO kv VALUES (?, ?)", [key, value])
        return True

    def update(self, key: bytes, value: bytes) -> bool:
        if value == b"\xff" * 8 or self.get(key) is None:
            return False
        self.db.execute("UPDATE kv SET value = ? WHERE key = ?", [value, key])
        return True

    def remove(self, key: bytes) -> bool:
        found = self.get(key) is not None
        self.db.execute("DELETE FROM kv WHERE key = ?", [key])
        return found

    def scan(self, low: bytes, high: bytes) -> list[tuple[bytes, bytes]]:
        return self.db.execute("SELECT key, value FROM kv WHERE key BETWEEN ? AND ? ORDER BY key", [low, high]).fetchall()

    def apply(self, requests: DataFrame) -> list[tuple[int, bool]]:
        run = {"insert": self.insert, "update": self.update, "delete": lambda k, _: self.remove(k)}
        return [(r.seq, run[r.op](bytes(r.key), None if r.value is None else bytes(r.value))) for r in requests.orderBy("seq").collect()]

    def bulk_load(self, rows: DataFrame) -> None:
        self.db.executemany("INSERT OR REPLACE INTO kv VALUES (?, ?)", [[bytes(r.key), bytes(r.value)] for r in rows.select("key", "value").collect()])
