"""Users, keys and databases as small tables, and who may do what."""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {"users": "user_id string, name string, is_root boolean, created_at long", "api_keys": "key_id string, user_id string, token_hash string, scopes string, revoked_at long, last_used_at long, created_at long", "databases": "db_id string, user_id string, name string, status string, created_at long"}
THROTTLE = 60


def allowed(scopes: str, wanted: str, root: bool = False) -> bool:
    """w includes r; root may do everything."""
    held = set(scopes.split(",")) | ({"r"} if "w" in scopes.split(",") else set())
    return root or wanted in held


def child_scopes(own: str, asked: list[str], root: bool = False) -> list[str]:
    """The asked scopes, if the caller has them all."""
    if not all(allowed(own, s, root) for s in asked):
        raise PermissionError("a key cannot grant more than it has")
    return sorted(set(asked))


class Catalog:
    """Immutable: each change returns a new catalog over new tables."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None):
        self.spark = spark
        self.tables = tables or {n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()}

    def _with(self, **changed: DataFrame) -> Catalog:
        return Catalog(self.spark, self.tables | changed)

    def _add(self, table: str, row: tuple) -> Catalog:
        return self._with(**{table: self.tables[table].union(self.spark.createDataFrame([row], SCHEMAS[table]))})

    def create_user(self, user_id: str, name: str, now: int, root: bool = False) -> Catalog:
        return self._add("users", (user_id, name, root, now))

    def issue_key(self, user_id: str, scopes: list[str], now: int) -> tuple[Catalog, str]:
        """(catalog, token): only the token's hash is kept."""
        token = secrets.token_urlsafe(32)
        digest = hashlib.sha256(token.encode()).hexdigest()
        return self._add("api_keys", (digest[:16], user_id, digest, ",".join(sorted(scopes)), None, None, now)), token

    def authenticate(self, token: str) -> DataFrame:
        """The live key of a token with its user."""
        digest = hashlib.sha256(token.encode()).hexdigest()
        return self.tables["api_keys"].filter((F.col("token_hash") == digest) & F.col("revoked_at").isNull()).join(self.tables["users"], "user_id")

    def touch(self, key_id: str, now: int) -> Catalog:
        """Last use, written once a minute at most."""
        stale = (F.col("key_id") == key_id) & (F.coalesce("last_used_at", F.lit(0)) <= now - THROTTLE)
        return self._with(api_keys=self.tables["api_keys"].withColumn("last_used_at", F.when(stale, F.lit(now)).otherwise(F.col("last_used_at"))))

    def revoke(self, key_id: str, user_id: str, now: int) -> Catalog:
        """One's own key; revoking again changes nothing."""
        mine = (F.col("key_id") == key_id) & (F.col("user_id") == user_id) & F.col("revoked_at").isNull()
        return self._with(api_keys=self.tables["api_keys"].withColumn("revoked_at", F.when(mine, F.lit(now)).otherwise(F.col("revoked_at"))))

    def create_database(self, db_id: str, user_id: str, name: str, now: int) -> Catalog:
        return self._add("databases", (db_id, user_id, name, "active", now))

    def databases(self, user_id: str, root: bool = False, include_archived: bool = False) -> DataFrame:
        out = self.tables["databases"] if root else self.tables["databases"].filter(F.col("user_id") == user_id)
        return out if include_archived else out.filter("status = 'active'")

    def archive_database(self, db_id: str) -> Catalog:
        hit = (F.col("db_id") == db_id) & (F.col("status") == "active")
        return self._with(databases=self.tables["databases"].withColumn("status", F.when(hit, "archived").otherwise(F.col("status"))))

    def drop_database(self, db_id: str) -> Catalog:
        return self._with(databases=self.tables["databases"].filter(F.col("db_id") != db_id))

    def user_detail(self) -> DataFrame:
        """Users with counts of live keys and databases."""
        keys = self.tables["api_keys"].filter("revoked_at is null").groupBy("user_id").agg(F.count("*").alias("n_keys"))
        dbs = self.tables["databases"].groupBy("user_id").agg(F.count("*").alias("n_databases"))
        return self.tables["users"].join(keys, "user_id", "left").join(dbs, "user_id", "left").fillna(0, ["n_keys", "n_databases"])

    def delete_user(self, user_id: str) -> Catalog:
        return self._with(**{n: t.filter(F.col("user_id") != user_id) for n, t in self.tables.items()})
