"""Backend urls, and JDBC options from them. A driver jar on Spark's class path is the user's to bring."""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import parse_qsl, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession

from tandemql.sql.dialect import Dialect

# Url schemes with their dialect and port, and the TLS parameters.
SCHEMES = {"mysql": (Dialect.MYSQL, 3306), "pgsql": (Dialect.POSTGRES, 5432), "postgres": (Dialect.POSTGRES, 5432), "postgresql": (Dialect.POSTGRES, 5432)}
TLS = ("ssl_mode", "ssl_ca", "ssl_cert", "ssl_key")


@dataclass(frozen=True)
class Backend:
    name: str
    dialect: Dialect
    host: str
    port: int
    user: str
    password: str
    database: str
    tls: dict[str, str] = field(default_factory=dict)

    def jdbc_options(self) -> dict[str, str]:
        scheme = "mysql" if self.dialect is Dialect.MYSQL else "postgresql"
        out = {"url": f"jdbc:{scheme}://{self.host}:{self.port}/{self.database}", "user": self.user, "password": self.password}
        if self.dialect is Dialect.MYSQL:
            names = {"ssl_mode": "sslMode", "ssl_ca": "serverSslCert", "ssl_cert": "clientCertificateKeyStoreUrl", "ssl_key": "clientKey"}
            return out | {"connectTimeout": "5000", "socketTimeout": "30000", "characterEncoding": "utf8"} | {names[k]: v for k, v in self.tls.items()}
        names = {"ssl_mode": "sslmode", "ssl_ca": "sslrootcert", "ssl_cert": "sslcert", "ssl_key": "sslkey"}
        return out | {"connectTimeout": "5", "socketTimeout": "30"} | {names[k]: v for k, v in self.tls.items()}

    def read(self, spark: SparkSession, query: str, **partitioning: str) -> DataFrame:
        """The rows of a query that the backend runs; Spark pushes filters and columns of what follows into it.

        ``partitioning``: partitionColumn, lowerBound, upperBound and numPartitions, to read in parallel; then
        ``query`` is the name of a table.
        """
        target = {"dbtable": query} if partitioning else {"query": query}
        return spark.read.format("jdbc").options(**self.jdbc_options(), **target, **partitioning).load()


def parse_backend(url: str) -> Backend:
    """``mysql://user:password@host:port/database?name=...&ssl_mode=...``"""
    parts = urlsplit(url)
    if parts.scheme not in SCHEMES:
        raise ValueError(f"unknown scheme in {url!r}")
    if not parts.hostname:
        raise ValueError(f"no host in {url!r}")
    dialect, port = SCHEMES[parts.scheme]
    query = dict(parse_qsl(parts.query, keep_blank_values=True))
    if unknown := set(query) - {"name", *TLS}:
        raise ValueError(f"unknown parameters {sorted(unknown)}")
    try:
        port = parts.port or port
    except ValueError:
        raise ValueError(f"bad port in {url!r}") from None
    database = parts.path.lstrip("/")
    tls = {k: query[k] for k in TLS if k in query}
    return Backend(query.get("name", f"{parts.hostname}:{port}"), dialect, parts.hostname, port, unquote(parts.username or ""), unquote(parts.password or ""), database, tls)


def union_backends(spark: SparkSession, backends: list[Backend], query: str) -> DataFrame:
    """A query's rows from all backends: scatter, and gather by position."""
    frames = [b.read(spark, query) for b in backends]
    out = frames[0]
    for df in frames[1:]:
        out = out.union(df)
    return out
