"""Column addresses over linked tables, as joins: ``ref.<key>.<column>``, ``out.<relation>``, ``in.<relation>`` and ``in.<type>:<key>`` (all
of a type that refer here by that key), up to four hops.

A schema names tables, their keys and what leads from one to another. Addresses that begin alike share their joins. A hop over a
reference has one target at most and is a left join; a relation may have many, so its values come as a list, gathered from the
distinct ones of each row, or serve as a condition (a semi join).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.operators.graphs import _cut

MOST_HOPS = 4
KINDS = ("ref", "out", "in")


class NoSuchAddress(ValueError):
    pass


@dataclass(frozen=True)
class Hop:
    kind: str
    name: str

    @property
    def many(self) -> bool:
        return self.kind != "ref"

    @property
    def inverse(self) -> tuple[str, str] | None:
        """Of ``type:key``, both; none for a relation."""
        kind, mark, key = self.name.partition(":")
        return (kind, key) if mark else None


@dataclass(frozen=True)
class Address:
    """Hops and the column at their end: none for the linked object itself; ``edge`` is a column of the last relation's rows."""

    hops: tuple[Hop, ...]
    column: str | None
    edge: str | None = None

    @classmethod
    def read(cls, text: str) -> Address:
        head, mark, edge = text.partition("~")
        words, hops = head.split("."), []
        while len(words) > 1 and words[0] in KINDS:
            hops.append(Hop(words[0], words[1]))
            words = words[2:]
        if len(hops) > MOST_HOPS:
            raise NoSuchAddress(f"{text}: more than {MOST_HOPS} hops")
        if len(words) > 1 or words == [""]:
            raise NoSuchAddress(f"{text}: an address ends with one column")
        column = words[0] if words else None
        if mark and (column or not edge or not hops or not hops[-1].many):
            raise NoSuchAddress(f"{text}: ~ stands behind a relation and before a column of its rows")
        if not mark and column is None and not hops[-1].many:
            raise NoSuchAddress(f"{text}: a reference is addressed by a column of its target, or by its own name")
        return cls(tuple(hops), column, edge if mark else None)

    @property
    def many(self) -> bool:
        return any(h.many for h in self.hops)


@dataclass(frozen=True)
class Relation:
    """Rows that link keys of two tables: where they come from, their columns of both ends, and the two tables."""

    rows: Callable[[], DataFrame]
    start: str
    end: str
    source: str
    target: str


@dataclass
class Schema:
    """Tables by name with their key column; references (table, column) to a table; relations by name."""

    tables: dict[str, Callable[[], DataFrame]]
    keys: dict[str, str]
    references: dict[tuple[str, str], str] = field(default_factory=dict)
    relations: dict[str, Relation] = field(default_factory=dict)

    def target(self, table: str, hop: Hop) -> str:
        if hop.kind == "ref":
            found = self.references.get((table, hop.name))
        elif hop.inverse:
            found = hop.inverse[0] if hop.kind == "in" and self.references.get(hop.inverse) == table else None
        else:
            r = self.relations.get(hop.name)
            found = None if r is None or (r.source if hop.kind == "out" else r.target) != table else r.target if hop.kind == "out" else r.source
        if found is None:
            raise NoSuchAddress(f"{table} has no {hop.kind}.{hop.name}")
        return found

    def checked(self, table: str, text: str) -> tuple[Address, list[str]]:
        """The address and the tables that it leads through; raises where a hop or a column isn't there."""
        address, at = Address.read(text), [table]
        for hop in address.hops:
            at.append(self.target(at[-1], hop))
        if address.column and address.column not in self.tables[at[-1]]().columns:
            raise NoSuchAddress(f"{at[-1]} has no column {address.column}")
        if address.edge and (address.hops[-1].inverse or address.edge not in self.relations[address.hops[-1].name].rows().columns):
            raise NoSuchAddress(f"{address.hops[-1].name} has no column {address.edge}")
        return address, at

    def _hopped(self, rows: DataFrame, here: str, table: str, hop: Hop, there: str, edge: str | None = None) -> DataFrame:
        """``rows`` with the key of the hop's target as ``there`` (and an edge column as ``there~``), from the key or reference ``here``."""
        if hop.kind == "ref":
            return rows.withColumnRenamed(here, there)
        return rows.join(self._links(hop, there, [edge] if edge else []), F.col(here) == F.col("_near"), "left").drop("_near")

    def _links(self, hop: Hop, there: str, edges: list[str]) -> DataFrame:
        """(_near, there, there~edge): the rows of a relation, or those of a type by its reference, with both ends."""
        if hop.inverse:
            kind, key = hop.inverse
            return self.tables[kind]().select(F.col(key).alias("_near"), F.col(self.keys[kind]).alias(there))
        r = self.relations[hop.name]
        near, far = (r.start, r.end) if hop.kind == "out" else (r.end, r.start)
        return r.rows().select(F.col(near).alias("_near"), F.col(far).alias(there), *[F.col(e).alias(f"{there}~{e}" if len(edges) > 1 else f"{there}~") for e in edges])

    def walked(self, table: str, text: str) -> DataFrame:
        """(key, value): the values that an address gives for each row of a table; several for relations, null where a hop leads nowhere."""
        address, at = self.checked(table, text)
        if not address.hops:
            return self.tables[table]().select(F.col(self.keys[table]).alias("key"), F.col(address.column).alias("value"))
        first = address.hops[0]
        rows = self.tables[table]().select(F.col(self.keys[table]).alias("key"), F.col(first.name if first.kind == "ref" else self.keys[table]).alias("_0"))
        for k, hop in enumerate(address.hops):
            last = k + 1 == len(address.hops)
            rows = self._hopped(rows, f"_{k}", at[k], hop, f"_{k + 1}", address.edge if last else None)
            then = address.hops[k + 1] if not last else None
            wanted = address.column if last else then.name if then.kind == "ref" else None
            if wanted and wanted != self.keys[at[k + 1]]:
                ends = self.tables[at[k + 1]]().select(F.col(self.keys[at[k + 1]]).alias("_end"), F.col(wanted).alias("_v"))
                rows = rows.join(ends, F.col(f"_{k + 1}") == F.col("_end"), "left").withColumn(f"_{k + 1}", F.col("_v")).drop("_end", "_v")
        end = f"_{len(address.hops)}"
        return rows.select("key", F.col(f"{end}~" if address.edge else end).alias("value"))

    def _valued(self, rows: DataFrame, at: str, table: str, wanted: dict[str, tuple[tuple[Hop, ...], str]]) -> DataFrame:
        """``rows`` with a column for each name of ``wanted`` (references, column): what they give for the object of ``table`` whose key is
        column ``at``. Each reference is joined once, with all columns that any name wants of its target."""
        needs: dict[tuple[Hop, ...], set[str]] = {}
        for hops, column in wanted.values():
            for k in range(len(hops) + 1):
                needs.setdefault(hops[:k], set()).add(hops[k].name if k < len(hops) else column)
        prefix = lambda hops: f"{at}/" + "".join(f"{h.name}." for h in hops)
        for hops in sorted(needs, key=len):
            end, own = table, prefix(hops)
            for h in hops:
                end = self.target(end, h)
            here, key = prefix(hops[:-1]) + hops[-1].name if hops else at, self.keys[end]
            if needs[hops] == {key}:
                rows = rows.withColumn(own + key, F.col(f"`{here}`"))
                continue
            found = self.tables[end]().select(F.col(key).alias(f"{own}#"), *[F.col(x).alias(own + x) for x in sorted(needs[hops])])
            rows = rows.join(found, F.col(f"`{here}`") == F.col(f"`{own}#`"), "left").drop(f"{own}#")
        return rows.withColumns({name: F.col(f"`{prefix(hops)}{column}`") for name, (hops, column) in wanted.items()})

    def _reached(self, table: str, prefixes: dict[tuple[Hop, ...], set[str]]) -> dict[tuple[Hop, ...], DataFrame]:
        """For each prefix of hops, which ends with a relation: (key, _at, _at~edge) of all that it leads to. A prefix of several others is
        walked once, and its rows are kept for all of them."""
        every = {p[:k] for p in prefixes for k in range(1, len(p) + 1)}
        used = {p: sum(q[:-1] == p for q in every) + (p in prefixes) for p in every}
        start = self.tables[table]().select(F.col(self.keys[table]).alias("key"), F.col(self.keys[table]).alias("_at"))
        found: dict[tuple[Hop, ...], DataFrame] = {(): start}
        for p in sorted(every, key=len):
            at, hop = table, p[-1]
            for h in p[:-1]:
                at = self.target(at, h)
            rows = found[p[:-1]].select("key", "_at")
            if hop.kind == "ref":
                rows = self._valued(rows, "_at", at, {"_to": ((), hop.name)}).select("key", F.col("_to").alias("_at"))
            else:
                edges = sorted(prefixes.get(p, ()))
                links = self._links(hop, "_to", edges)
                names = [f"_to~{e}" if len(edges) > 1 else "_to~" for e in edges]
                rows = rows.join(links, F.col("_at") == F.col("_near"), "left").select("key", F.col("_to").alias("_at"), *[F.col(f"`{n}`").alias(f"_at~{e}") for n, e in zip(names, edges)])
            found[p] = _cut(rows) if used[p] > 1 else rows
        return found

    def with_columns(self, table: str, addresses: dict[str, str]) -> DataFrame:
        """The table's key and a column for each address, lists (sorted, distinct, empty if there is none) for relations.

        Addresses that begin alike share their joins: a reference is joined once with all columns that are wanted of it, a relation once for
        all lists behind it, which are gathered together.
        """
        read = {name: self.checked(table, text)[0] for name, text in addresses.items()}
        one = {name: (a.hops, a.column) for name, a in read.items() if not a.many}
        key = self.keys[table]
        out = self.tables[table]()
        direct = {name: column for name, (hops, column) in one.items() if not hops}
        refs = {name: x for name, x in one.items() if x[0]}
        if refs:
            # what the first hops want of the table is there already
            begins: dict[Hop, dict[str, tuple[tuple[Hop, ...], str]]] = {}
            for name, (hops, column) in refs.items():
                begins.setdefault(hops[0], {})[name] = (hops[1:], column)
            for hop, wanted in begins.items():
                out = self._valued(out, hop.name, self.target(table, hop), wanted)
        out = out.withColumns({name: F.col(column) for name, column in direct.items()}).select(F.col(key).alias("key"), *one)
        groups: dict[tuple[Hop, ...], dict[str, Address]] = {}
        for name, a in read.items():
            if a.many:
                last = max(k for k, h in enumerate(a.hops) if h.many)
                groups.setdefault(a.hops[: last + 1], {})[name] = a
        reached = self._reached(table, {p: {a.edge for a in own.values() if a.edge} for p, own in groups.items()}) if groups else {}
        for p, own in groups.items():
            at = table
            for h in p:
                at = self.target(at, h)
            rows = reached[p]
            ends = {name: (a.hops[len(p) :], a.column or self.keys[at]) for name, a in own.items() if not a.edge}
            rows = self._valued(rows, "_at", at, ends) if ends else rows
            rows = rows.withColumns({name: F.col(f"`_at~{a.edge}`") for name, a in own.items() if a.edge})
            lists = rows.groupBy(F.col("key").alias("_key")).agg(*[F.array_sort(F.collect_set(name)).alias(name) for name in own])
            out = out.join(lists, F.col("key") == F.col("_key"), "left").drop("_key")
        return out.select("key", *addresses)

    def where(self, table: str, text: str, condition: Callable[[Column], Column]) -> DataFrame:
        """Rows of a table for which a value at the address meets a condition (one of several is enough): a semi join, never a multiplied row."""
        found = self.walked(table, text).where(condition(F.col("value"))).select(F.col("key").alias("_key"))
        return self.tables[table]().join(found, F.col(self.keys[table]) == F.col("_key"), "left_semi")

    def grouped(self, table: str, text: str) -> DataFrame:
        """(value, n): rows of a table by the value at an address; a row counts once in each of its values."""
        rows = self.walked(table, text)
        rows = rows.distinct() if Address.read(text).many else rows
        return rows.groupBy("value").agg(F.count("*").alias("n"))
