"""Tables, attributes and foreign-key relationships of a schema."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class TableDef:
    """A table: its key, and the attributes that models leave out."""

    name: str
    key: str | None = None
    irrelevant: tuple[str, ...] = ()


@dataclass(frozen=True)
class Relationship:
    """``child.fk = parent.pk``."""

    child: str
    fk: str
    parent: str
    pk: str

    @property
    def fan_out(self) -> str:
        """Name of the parent's column with the number of its children."""
        return f"mul_{self.child}_{self.fk}"


@dataclass(frozen=True)
class SchemaGraph:
    tables: tuple[TableDef, ...]
    relationships: tuple[Relationship, ...] = field(default=())

    def table(self, name: str) -> TableDef:
        return next(t for t in self.tables if t.name == name)

    def edge(self, child: str, parent: str) -> Relationship:
        return next(r for r in self.relationships if (r.child, r.parent) == (child, parent))

    def read(self, spark: SparkSession, folder: str, name: str) -> DataFrame:
        """A table without its irrelevant attributes."""
        return spark.read.parquet(f"{folder}/{name}.parquet").drop(*self.table(name).irrelevant)


def order_schema() -> SchemaGraph:
    """The schema of the order tables."""
    return SchemaGraph(
        tables=(
            TableDef("region", "r_regionkey"),
            TableDef("nation", "n_nationkey"),
            TableDef("customer", "c_custkey", ("c_name",)),
            TableDef("supplier", "s_suppkey", ("s_name",)),
            TableDef("part", "p_partkey", ("p_name",)),
            TableDef("orders", "o_orderkey"),
            TableDef("lineitem"),
            TableDef("documents", "doc_id", ("text",)),
            TableDef("labels"),
        ),
        relationships=(
            Relationship("nation", "n_regionkey", "region", "r_regionkey"),
            Relationship("customer", "c_nationkey", "nation", "n_nationkey"),
            Relationship("supplier", "s_nationkey", "nation", "n_nationkey"),
            Relationship("orders", "o_custkey", "customer", "c_custkey"),
            Relationship("lineitem", "l_orderkey", "orders", "o_orderkey"),
            Relationship("lineitem", "l_partkey", "part", "p_partkey"),
            Relationship("lineitem", "l_suppkey", "supplier", "s_suppkey"),
            Relationship("labels", "doc_id", "documents", "doc_id"),
        ),
    )
