"""Federated resolution over several fact sources with a four-state outcome."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_key
from ..operators import lookup
from ..schemas import TYPE_KINDS

#: Module kinds whose members a source may know, by role.
MODULE_ROLES = {"object": "object_module", "manager": "manager_module", "form": "form_module", "record_set": "record_set_module", "command": "command_module", "common": "common_module"}
MEMBER_ROLES = ("object", "manager", "form")


class FactSource(ABC):
    """A source of facts under a name; facts carry the source in their id."""

    name: str
    capabilities: frozenset[str] = frozenset({"resolve"})

    @abstractmethod
    def resolve(self, queries: DataFrame) -> DataFrame:
        """(query, id) of the facts that the names in the column `query` stand for."""

    def members(self, owner_id: str, name: str | None = None, kind: str | None = None) -> DataFrame | None:
        """Members of a fact, None if the source does not have members."""
        return None

    def callables(self, owner_id: str | None, name: str | None = None) -> DataFrame | None:
        return None

    def related(self, fact_id: str, kind: str | None = None) -> DataFrame | None:
        return None

    def availability(self, mask: int, mode: str) -> DataFrame | None:
        return None

    def module_context(self, kind: str) -> ModuleContext | None:
        """What a module of the kind sees, None if the source does not know modules."""
        return None

    def describe(self) -> dict:
        return {"source": self.name, "capabilities": sorted(self.capabilities)}


@dataclass
class ModuleContext:
    """The self member (id) of a module, and (id, kind, name_primary) of what it holds."""

    id: str
    sources: list[str]
    self_member: str | None = None
    properties: DataFrame | None = None
    methods: DataFrame | None = None
    events: DataFrame | None = None
    facts: list[str] = field(default_factory=list)

    def holds(self) -> bool:
        return bool(self.sources or self.self_member or self.facts)


def merge_contexts(kind: str, contexts: Sequence[ModuleContext]) -> ModuleContext | None:
    """One context of several: the first one's id and self member stay, other self members
    become facts, sources are listed once, members are united. None if nothing is held."""
    merged = ModuleContext(f"module_context:{kind}", [])
    for number, found in enumerate(contexts):
        if not number:
            merged.id = found.id
        merged.sources += [s for s in found.sources if s not in merged.sources]
        if merged.self_member is None:
            merged.self_member = found.self_member
        elif found.self_member is not None:
            merged.facts.append(found.self_member)
        for name in ("properties", "methods", "events"):
            mine, theirs = getattr(merged, name), getattr(found, name)
            setattr(merged, name, mine if theirs is None else theirs if mine is None else mine.unionByName(theirs))
        merged.facts += found.facts
    return merged if merged.holds() else None


class IndexSource(FactSource):
    """A source over the tables of an index."""

    def __init__(self, name: str, tables: dict[str, DataFrame], kinds: Sequence[str] | None = None):
        self.name, self.tables = name, tables
        self.documents = tables["documents"] if kinds is None else tables["documents"].where(F.col("kind").isin(*kinds))
        known = {"members": "members", "callables": "callables", "relations": "related"}
        self.capabilities = frozenset({"resolve", *(c for t, c in known.items() if t in tables)})

    def resolve(self, queries: DataFrame) -> DataFrame:
        return lookup.by_name(self.tables["document_names"], self.documents, queries).select("query", "id")

    def resolve_type(self, queries: DataFrame) -> DataFrame:
        """(query, id) of types only."""
        types = self.documents.where(F.col("kind").isin(*TYPE_KINDS))
        return lookup.by_name(self.tables["document_names"], types, queries, ["primary", "alias"]).select("query", "id")

    def members(self, owner_id, name=None, kind=None):
        """Members of a type; the values of an enum are its members. A name is compared as it
        is written."""
        if "members" not in self.tables:
            return None
        found = lookup.members_of(self.tables["members"], self.documents, owner_id, None, kind)
        if kind in (None, "enum_value") and "relations" in self.tables:
            values = self.documents.where("kind = 'enum_value'").join(self._owned(owner_id), "id", "left_semi").withColumn("member_name", F.col("name_primary"))
            found = found.unionByName(values.select(*found.columns))
        return found if name is None else found.where((F.col("name_primary") == name) | (F.col("name_alias") == name))

    def _owned(self, owner_id: str) -> DataFrame:
        """Ids of what the edges say that the owner owns."""
        return self.tables["relations"].where((F.col("source_id") == owner_id) & (F.col("edge_kind") == "owns")).select(F.col("target_id").alias("id"))

    def module_context(self, kind):
        """Events of the modules of the kind, with the global methods and properties."""
        if kind not in MODULE_ROLES.values():
            return None
        columns = ("id", "kind", "name_primary")
        of_kind = self.tables["document_names"].where((F.col("key_kind") == "module_context") & (F.col("key") == normalize_key(F.lit(kind.removesuffix("_module")))))
        events = self.documents.where("kind = 'module_event'").join(of_kind.select(F.col("document_id").alias("id")).distinct(), "id", "left_semi")
        methods, properties = (self.documents.where(F.col("kind") == k).select(*columns) for k in ("global_method", "global_property"))
        return ModuleContext(f"{self.name}/module_context:{kind}", [self.name], None, properties, methods, events.select(*columns))

    def callables(self, owner_id, name=None):
        return lookup.callables_of(self.tables["callables"], self.documents, owner_id, name) if "callables" in self.tables else None

    def related(self, fact_id, kind=None):
        from ..operators.graph import neighbours

        return neighbours(self.tables["relations"], fact_id, kind).limit(20) if "relations" in self.tables else None

    def availability(self, mask, mode):
        from ..functions.availability import array_mask, available

        return self.documents.where(available(array_mask(F.coalesce("availability_contexts", F.array().cast("array<string>"))), mask, mode))


class LanguageSource(FactSource):
    """Facts of the language pages (operators.language.FACT); they have no members."""

    capabilities = frozenset({"resolve", "callables"})

    def __init__(self, name: str, facts: DataFrame, domain: str):
        self.name, self.documents = name, facts.where(F.col("domain") == domain)

    def resolve(self, queries):
        wanted = queries.select("query", normalize_key("query").alias("key")).distinct()
        keys = F.array_compact(F.array(normalize_key("name_primary"), normalize_key("name_alias")))
        names = self.documents.select("id", F.explode(F.array_distinct(keys)).alias("key"))
        return names.join(wanted, "key").select("query", "id").distinct()

    def callables(self, owner_id, name=None):
        found = self.documents.where("kind = 'language_function'")
        key = normalize_key(F.lit(name))
        return found if name is None else found.where((normalize_key("name_primary") == key) | (normalize_key("name_alias") == key))


class QueryTableSource(IndexSource):
    """Query tables of an index by name, syntax or identifier; members are not supported, the
    fields and parameters of a table are enumerated directly."""

    def __init__(self, name: str, tables: dict[str, DataFrame]):
        super().__init__(name, tables, ("query_table", "query_field", "query_parameter"))
        self.capabilities = frozenset({"resolve"})

    def resolve(self, queries):
        tables = self.documents.where("kind = 'query_table'")
        return lookup.by_name(self.tables["document_names"], tables, queries).select("query", "id")

    def members(self, owner_id, name=None, kind=None):
        return None

    def callables(self, owner_id, name=None):
        return None

    def _parts(self, table_id: str, kind: str, name: str | None) -> DataFrame:
        found = self.documents.where(F.col("kind") == kind).join(self._owned(table_id), "id", "left_semi")
        key = normalize_key(F.lit(name))
        found = found if name is None else found.where((normalize_key("name_primary") == key) | (normalize_key("name_alias") == key))
        return found.orderBy("kind_priority", "id")

    def fields(self, table_id: str, name: str | None = None) -> DataFrame:
        return self._parts(table_id, "query_field", name)

    def parameters(self, table_id: str, name: str | None = None) -> DataFrame:
        return self._parts(table_id, "query_parameter", name)


def composite(asked: DataFrame, answers: DataFrame, active: Sequence[str], unsupported: Sequence[str] = ()) -> DataFrame:
    """query, status, n_facts, facts and candidates of every asked query.

    answers: (query, source, id). A source with one answer gives a fact, one with several is
    ambiguous. Any ambiguity wins, and then the facts of the others are candidates as well;
    else no facts are not_found (unsupported, if some source cannot tell), one is ok, more
    are ambiguous.
    """
    known = answers.where(F.col("source").isin(*active)).distinct()
    per = known.groupBy("query", "source").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))
    facts = F.flatten(F.collect_list(F.when(F.col("n") == 1, F.col("ids"))))
    merged = per.groupBy("query").agg(F.max(F.col("n") > 1).alias("torn"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("n"), F.array_sort(facts).alias("facts"), F.flatten(F.collect_list("ids")).alias("all"))
    joined = asked.select("query").distinct().join(merged, "query", "left")
    torn, n = F.coalesce("torn", F.lit(False)), F.coalesce("n", F.lit(0))
    none = F.lit("unsupported" if unsupported else "not_found")
    status = F.when(torn | (n > 1), "ambiguous").when(n == 1, "ok").otherwise(none)
    empty = F.array().cast("array<string>")
    return joined.select("query", status.alias("status"), n.alias("n_facts"), F.coalesce("facts", empty).alias("facts"), F.when(status == "ambiguous", F.array_sort(F.col("all"))).otherwise(empty).alias("candidates"))


class CompositeResolver:
    """Resolution over sources; ids go to the source that owns them (`source/local id`)."""

    def __init__(self, sources: Sequence[FactSource], active: Sequence[str] | None = None):
        self.sources = {s.name: s for s in sources}
        self.active = list(active if active is not None else self.sources)

    def by_name(self, queries: DataFrame) -> DataFrame:
        answers = None
        for name in self.active:
            rows = self.sources[name].resolve(queries).select("query", F.concat_ws("/", F.lit(name), "id").alias("id"), F.lit(name).alias("source"))
            answers = rows if answers is None else answers.unionByName(rows)
        return composite(queries, answers, self.active)

    def owner(self, fact_id: str) -> tuple[FactSource | None, str]:
        source, _, local = fact_id.partition("/")
        return (self.sources.get(source) if source in self.active else None), local

    def by_id(self, fact_id: str) -> tuple[str, DataFrame | None]:
        source, local = self.owner(fact_id)
        if source is None:
            return "not_found", None
        found = source.documents.where(F.col("id") == local)
        return ("ok" if found.limit(1).count() else "not_found"), found

    def members(self, owner_id: str, name: str | None = None, kind: str | None = None) -> tuple[str, DataFrame | None]:
        return self._routed(owner_id, lambda s, local: s.members(local, name, kind))

    def callables(self, owner_id: str, name: str | None = None) -> tuple[str, DataFrame | None]:
        return self._routed(owner_id, lambda s, local: s.callables(local, name))

    def related(self, fact_id: str, kind: str | None = None) -> tuple[str, DataFrame | None]:
        return self._routed(fact_id, lambda s, local: s.related(local, kind))

    def _routed(self, fact_id: str, ask) -> tuple[str, DataFrame | None]:
        source, local = self.owner(fact_id)
        if source is None:
            return "not_found", None
        found = ask(source, local)
        return ("unsupported", None) if found is None else ("ok", found)

    def global_context(self, kinds: Sequence[str] = ("global_method", "global_property")) -> DataFrame | None:
        """Global methods and properties of all active sources, one row for each fact."""
        found = None
        for name in self.active:
            rows = self.sources[name].documents.where(F.col("kind").isin(*kinds)).select(F.concat_ws("/", F.lit(name), "id").alias("id"), "kind", "name_primary", "name_alias")
            found = rows if found is None else found.unionByName(rows)
        return found if found is None else found.dropDuplicates(["id"])

    def describe(self) -> list[dict]:
        return [self.sources[name].describe() for name in self.active]

    def module_context(self, kind: str, only: Sequence[str] = ()) -> tuple[str, ModuleContext | None]:
        """The merged context of a module kind over the active sources (or those of `only`)."""
        asked = [self.sources[n] for n in self.active if not only or n in only]
        known = [c for c in (s.module_context(kind) for s in asked) if c is not None]
        if asked and not known:
            return "unsupported", None
        merged = merge_contexts(kind, known)
        return ("ok", merged) if merged else ("not_found", None)

    def metadata_module(self, selector: str, selectors: Mapping[str, str] | None = None) -> str | None:
        """Module kind of a selector such as a role or a spelling of it; None if there is none."""
        table = {k: v for k, v in MODULE_ROLES.items()} | dict(selectors or {})
        return table.get(selector.strip().lower())

    def module_members(self, role: str, owner_id: str) -> tuple[str, DataFrame | None]:
        """Members of a module of the given role: properties, then methods, then events."""
        if role not in MODULE_ROLES or role not in MEMBER_ROLES:
            return "unsupported", None
        status, found = self.members(owner_id)
        if found is None:
            return status, None
        order = F.when(F.col("kind") == "property", 0).when(F.col("kind") == "method", 1).otherwise(2)
        return status, found.where(F.col("kind") != "enum_value").orderBy(order, normalize_key("name_primary"), "id")
