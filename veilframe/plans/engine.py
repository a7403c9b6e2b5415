"""The engine: detect, mask, restore and chat over tables of payloads, by one configuration.

Payload tables hold payload_id, payload and system_id. A null payload gives null results, an empty one
itself. The configuration is part of the plan: rules become a literal map, disabled categories
are never looked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.text import store_key, utf8
from veilframe.operators import spans as S
from veilframe.operators.detect import detect, detect_long
from veilframe.operators.scan import lexicon
from veilframe.plans.config import Config, System, checked

RULE_MAP = "map<string,struct<enabled:boolean,strategy:string,requires_companion:array<string>,min_confidence:double>>"


def rule_map(system: System, config: Config) -> Column:
    """A system's rules as a literal; user-defined categories without a rule are not in it."""
    entries = []
    for name, r in system.types.items():
        entries += [F.lit(name), F.struct(F.lit(r.enabled).alias("enabled"), F.lit(r.strategy).alias("strategy"), F.array(*map(F.lit, r.requires_companion)).cast("array<string>").alias("requires_companion"), F.lit(r.min_confidence).cast("double").alias("min_confidence"))]
    return F.create_map(*entries) if entries else F.map_from_arrays(F.array(), F.array()).cast(RULE_MAP)


def strategy_map(system: System, config: Config, only: str | None = None) -> Column:
    names = {t.name: t.strategy for t in config.custom_types} | {n: r.strategy for n, r in system.types.items()}
    return F.create_map(*[F.lit(x) for n, s in names.items() for x in (n, only or s)])


def by_system(systems: list[System], make: Callable[[System], Column]) -> Column:
    """What make() gives for the row's system (column _system)."""
    if len(systems) == 1:
        return make(systems[0])
    return F.element_at(F.create_map(*[x for s in systems for x in (F.lit(s.id), make(s))]), F.col("_system"))


class Engine:
    def __init__(self, config: Config):
        self.config = checked(config)
        self.dictionaries = {"words": lexicon.load(config.words)} if config.words else {}

    def _enabled(self, system: System) -> list[str]:
        return [t for t, r in system.types.items() if r.enabled and not any(c.name == t for c in self.config.custom_types)]

    def _kept(self, df: DataFrame, systems: list[System], text: str) -> DataFrame:
        """df with the spans that its systems' rules let pass; the systems enable the same categories."""
        c = self.config
        found = detect(df, text, self._enabled(systems[0]), c.custom_types, c.ref_year, self.dictionaries, c.chunk_bytes, c.chunk_overlap, on_error=c.on_error, mailboxes=c.mailboxes)
        floors = {t.name: t.min_confidence for t in c.custom_types if t.name not in systems[0].types}
        plain = not floors and all(r.enabled and not r.requires_companion and r.min_confidence in (0, 0.7) for s in systems for r in s.types.values())
        if plain:  # one floor for all: a map lookup of each span would say the same
            return found.withColumn("spans", F.filter("spans", lambda s: s["conf"] >= 0.7))
        return found.withColumn("spans", S.passes_rules(F.col("spans"), by_system(systems, lambda s: rule_map(s, c)), floors))

    def detect(self, df: DataFrame, system_id: str = "default", text: str = "payload") -> DataFrame:
        """df with `spans`: places and categories, never values."""
        return self._kept(df, [self._system(system_id)], text)

    def detect_long(self, df: DataFrame, key: str, system_id: str = "default", text: str = "payload") -> DataFrame:
        """(key, spans) that the system's rules let pass, for tables with documents of any length: chunks are rows of
        their own. key must name a row."""
        c, system = self.config, self._system(system_id)
        found = detect_long(df, key, text, self._enabled(system), c.custom_types, c.ref_year, self.dictionaries, c.chunk_bytes, c.chunk_overlap, c.on_error, c.mailboxes)
        floors = {t.name: t.min_confidence for t in c.custom_types if t.name not in system.types}
        return found.withColumn("spans", S.passes_rules(F.col("spans"), rule_map(system, c), floors))

    def _system(self, system_id: str | None) -> System:
        found = self.config.system(system_id)
        if found is None:
            raise ValueError(f"no enabled system {system_id!r}")
        return found

    def _masked(self, df: DataFrame, systems: list[System], text: str, strategy: str | None = None, widen: bool | None = None) -> DataFrame:
        c = self.config
        kept = self._kept(df, systems, text)
        if c.expand_labels if widen is None else widen:
            kept = kept.withColumn("spans", S.expand_labels(text, F.col("spans")))
        names = by_system(systems, lambda s: strategy_map(s, c, strategy))
        out = kept.withColumn("_data", utf8(text)).withColumn("_made", S.apply_masks(F.col("_data"), F.col("spans"), names, **self._options(systems, strategy))).drop("_data")
        return out.withColumn("masked", S.rewritten(text, F.col("_made"))).withColumn("replacements", S.replacements(F.col("_made"))).withColumn("types", F.array_distinct(F.transform("_made", lambda p: p["type"]))).drop("_made")

    def _options(self, systems: list[System], strategy: str | None = None) -> dict:
        c = self.config
        used = {strategy} if strategy else {r.strategy for s in systems for r in s.types.values()} | {t.strategy for t in c.custom_types}
        return {"synthetic": "synthetic" in used, "labels": {t.name: t.label for t in c.custom_types if t.label}, "salt": c.token_salt}

    def mask_values(self, df: DataFrame, system_id: str = "default", text: str = "payload") -> DataFrame:
        """df with `spans` and `masked`: values that were found somewhere in a text are masked in all of it, not by their
        places: glued to another word, too, but only as they are spelled in lower case."""
        system = self._system(system_id)
        masked = S.masked_values(text, F.col("spans"), strategy_map(system, self.config), **self._options([system]))
        return self._kept(df, [system], text).withColumn("masked", masked)

    def mask(self, df: DataFrame, text: str = "payload") -> DataFrame:
        """df with spans, masked, replacements, types. Rows are masked by the rules of their own system; an unknown
        system falls back to the default one, or gives nulls where a system is required.

        Systems that enable the same categories, as all do by default, share one pass over the table."""
        if "system_id" not in df.columns:
            return self._masked(df, [self._system(None)], text)
        groups: dict[tuple[str, ...], list[System]] = {}
        for s in self.config.systems:
            if s.enabled:
                groups.setdefault((*sorted(self._enabled(s)), *sorted(s.types)), []).append(s)
        default = self.config.system(None)
        ids = [s.id for g in groups.values() for s in g]
        routed = df.withColumn("_system", F.when(F.col("system_id").isin(ids), F.col("system_id")).otherwise(F.lit(default.id if default else None).cast("string")))
        if len(groups) == 1 and default:
            return self._masked(routed, next(iter(groups.values())), text).drop("_system")
        parts = [self._masked(routed.where(F.col("_system").isin([s.id for s in g])), g, text) for g in groups.values()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        lost = routed.where("_system is null")
        for name in ("spans", "masked", "replacements", "types"):
            lost = lost.withColumn(name, F.lit(None).cast(out.schema[name].dataType))
        return out.unionByName(lost).drop("_system")

    def mapping(self, masked: DataFrame) -> DataFrame:
        """What restoring needs, of payloads that were changed, for systems that may restore: (key, original, masked)."""
        allowed = [s.id for s in self.config.systems if s.demask]
        limit = self.config.store.max_value_bytes
        kept = masked.where(F.size("replacements") > 0).where(F.length(F.trim("payload_id")) > 0).where((F.octet_length("payload") <= limit) & (F.octet_length("masked") <= limit))
        if "system_id" in masked.columns:
            known = [s.id for s in self.config.systems]
            kept = kept.where(F.when(F.col("system_id").isin(known), F.col("system_id")).otherwise(self.config.default_system).isin(allowed))
        rows = kept.select(store_key("payload_id").alias("key"), F.col("payload").alias("original"), "masked", "types")
        return rows.groupBy("key").agg(F.max_by(F.struct("original", "masked", "types"), F.struct("original")).alias("e")).select("key", "e.*")

    def demask(self, df: DataFrame, mapping: DataFrame) -> DataFrame:
        """df with operation and result: a masked payload gives its original, an original its mask again; a
        payload without an entry that looks masked is echoed, any other is masked."""
        joined = df.withColumn("key", store_key("payload_id")).join(mapping.select("key", "original", F.col("masked").alias("_known")), "key", "left")
        op = S.decide(F.col("original"), F.col("_known"), F.col("payload"), self.has_label_rule(df))
        placed = self.mask(joined.withColumn("operation", op))
        result = F.when(F.col("operation") == "demask", F.col("original")).when(F.col("operation") == "again", F.col("_known")).when(F.col("operation") == "echo", F.col("payload")).otherwise(F.col("masked"))
        return placed.withColumn("result", result).select(*df.columns, "operation", "result")

    def has_label_rule(self, df: DataFrame) -> Column:
        """Whether the row's system has an enabled rule with the label strategy."""
        ids = [s.id for s in self.config.systems if any(r.enabled and r.strategy == "label" for r in s.types.values())]
        known = [s.id for s in self.config.systems]
        system = F.when(F.col("system_id").isin(known), F.col("system_id")).otherwise(self.config.default_system) if "system_id" in df.columns else F.lit(self.config.default_system)
        return F.coalesce(system.isin(ids), F.lit(False))

    def leak_guard(self, masked: DataFrame, system_id: str = "default") -> DataFrame:
        """masked with `leaks`: spans that a second detection finds outside all masks."""
        again = self._kept(masked.drop("spans"), [self._system(system_id)], "masked")
        return again.withColumn("leaks", S.leaks(F.col("spans"), F.col("replacements"))).drop("spans")

    def chat(self, conversations: DataFrame, system_id: str = "chat-assistant", answer: Callable[[Column], Column] | None = None) -> DataFrame:
        """One row per conversation: masked messages, leak flag and status, answer, restored answer, counts by category.

        conversations: conv_id, turn, role, text. Messages are masked one by one, without state; a conversation with a leak
        gets status 422 and no answer. What is grouped by conversation is its own messages only."""
        system = self._system(system_id)
        messages = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
        masked = self.leak_guard(self._masked(messages, [system], "text", self.config.llm.strategy, widen=False), system_id)
        grouped = masked.groupBy("conv_id").agg(
            F.array_sort(F.collect_list(F.struct("turn", "role", "masked"))).alias("messages"),
            F.max(F.size("leaks") > 0).alias("leak"),
            F.flatten(F.collect_list("replacements")).alias("replacements"),
        )
        asked = (answer or demo_answer)(F.col("messages"))
        replied = grouped.withColumn("status", F.when(F.col("leak"), 422).otherwise(200)).withColumn("answer", F.when(~F.col("leak"), asked))
        restored = S.restore_text("answer", F.col("replacements")) if system.demask else F.col("answer")
        return replied.withColumn("restored", restored).withColumn("counts", S.type_counts(F.col("replacements"))).drop("replacements")


def demo_answer(messages: Column) -> Column:
    """An answer without a model: the last user message, quoted."""
    said = F.filter(messages, lambda m: m["role"] == "user")
    return F.concat(F.lit("You wrote: "), F.coalesce(F.element_at(said, -1)["masked"], F.lit("")))
