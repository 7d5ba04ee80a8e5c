"""Flattening a nested knowledge base into chunks, merging updates into it, exact top-k with a filter behind it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.operators.dedup import padded, usable
from grainmill.sources.scratch import small, table

STRESSOR = "label: string, description: string, signal_phrases: map<string, array<string>>, linked_emotions: array<string>, guardrails: array<string>, cultural_context_notes: array<string>, escalation_markers: array<string>, co_emotion_patterns: map<string, string>, response_templates: map<string, string>, what_not_to_say: array<string>, reflection_frames: array<string>"
TONE = "description: string, when_to_use: array<string>, linguistic_markers: struct<prefer: array<string>, avoid: array<string>>"
IDIOM = "translation: string, meaning: string, linked_stressors: array<string>, risk_amplifier: boolean, escalates_stressors: array<string>"
#: Schema of a knowledge base document.
KB_SCHEMA = (
    f"stressor_taxonomy map<string, struct<{STRESSOR}>>, tone_modes map<string, struct<{TONE}>>, guardrail_registry map<string, string>, "
    f"cultural_idioms map<string, struct<{IDIOM}>>, crisis_keywords map<string, array<string>>, _meta map<string, string>"
)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _filled(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) > 0


# The wording of chunks, which searches read.
def chunks(kb: DataFrame) -> DataFrame:
    """part, id, text, source, stressor_type, chunk_type, guardrail_id: stressors, tones, guardrails, idioms (part 1 to 4). Empty lists give no chunk."""
    none = F.lit(None).cast("string")
    s = kb.select(F.explode("stressor_taxonomy").alias("id", "v"))
    tagged = lambda df, text, source, kind: df.select(F.lit(1).alias("part"), "id", text.alias("text"), F.lit(source).alias("source"), F.col("id").alias("stressor_type"), F.lit(kind).alias("chunk_type"), none.alias("guardrail_id"))
    phrases = s.select("id", F.explode("v.signal_phrases").alias("lang", "list")).where(_filled(F.col("list")))
    parts = [
        tagged(s, F.concat(F.coalesce("v.label", "id"), F.lit(": "), _text(F.col("v.description"))), "stressor_taxonomy", "description"),
        tagged(phrases, F.concat(F.lit("Signal phrases ("), "lang", F.lit(") for "), "id", F.lit(": "), F.array_join(F.slice("list", 1, 12), "; ")), "signal_phrases", "signal_phrases"),
        tagged(s.where(_filled(F.col("v.linked_emotions"))), F.concat(F.lit("Common emotions in "), "id", F.lit(": "), F.array_join("v.linked_emotions", ", ")), "emotion_map", "emotions"),
        tagged(s.where(_filled(F.col("v.guardrails"))), F.concat(F.lit("Guardrails for "), "id", F.lit(": "), F.array_join("v.guardrails", "; ")), "guardrails", "guardrails"),
    ]
    plain = lambda df, part, text, source, kind, gid=none: df.select(F.lit(part).alias("part"), "id", text.alias("text"), F.lit(source).alias("source"), none.alias("stressor_type"), F.lit(kind).alias("chunk_type"), gid.alias("guardrail_id"))
    joined = lambda c, sep: _text(F.array_join(c, sep))
    t = kb.select(F.explode("tone_modes").alias("id", "v"))
    tone = F.concat(F.lit("Tone "), "id", F.lit(": "), _text(F.col("v.description")), F.lit(". When: "), joined("v.when_to_use", ", "), F.lit(". Prefer: "), joined("v.linguistic_markers.prefer", "; "), F.lit(". Avoid: "), joined("v.linguistic_markers.avoid", "; "), F.lit("."))
    g = kb.select(F.explode("guardrail_registry").alias("id", "v"))
    i = kb.select(F.explode("cultural_idioms").alias("id", "v"))
    idiom = F.concat(F.lit("South Asian idiom '"), "id", F.lit("' ("), _text(F.col("v.translation")), F.lit("): "), _text(F.col("v.meaning")), F.lit(" Linked to: "), joined("v.linked_stressors", ", "), F.lit("."))
    parts += [plain(t, 2, tone, "tone_modes", "tone_mode"), plain(g, 3, F.concat(F.lit("Guardrail '"), "id", F.lit("': "), _text(F.col("v"))), "guardrail_registry", "guardrail", F.col("id")), plain(i, 4, idiom, "cultural_idioms", "idiom")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: What a row of updates is taken to be wide at most, when their table is counted for a broadcast.
UPDATE_BYTES = 64 << 10


def enrich(kb: DataFrame, fields: DataFrame, keywords: dict[str, list[str]] | None = None, idioms: DataFrame | None = None, sections: dict[str, Column] | None = None, meta: dict[str, str] | None = None) -> DataFrame:
    """kb with fields of its own stressors replaced where `fields` (id and any stressor columns) holds a value, keywords appended if absent, idiom risk set, whole sections set, and entries of _meta set.

    Only stressors and idioms that are there are touched. One document a row; updates are small tables.
    """
    own = table(kb.withColumn("_doc", F.monotonically_increasing_id()), "documents")
    held = own.select("_doc", F.explode("stressor_taxonomy").alias("id", "v")).join(small(fields.withColumnsRenamed({c: f"new_{c}" for c in fields.columns if c != "id"}), UPDATE_BYTES), "id", "left")
    names = [f.split(":")[0].strip() for f in _split_fields(STRESSOR)]
    merged = F.struct(*[F.coalesce(F.col(f"new_{n}"), F.col(f"v.{n}")).alias(n) if n in fields.columns else F.col(f"v.{n}").alias(n) for n in names])
    taxonomy = held.groupBy("_doc").agg(F.map_from_entries(F.collect_list(F.struct("id", merged.alias("v")))).alias("_taxonomy"))
    out = own.join(taxonomy, "_doc", "left").withColumn("stressor_taxonomy", F.coalesce("_taxonomy", "stressor_taxonomy")).drop("_taxonomy")
    for tier, words in (keywords or {}).items():
        now = F.coalesce(F.col("crisis_keywords")[tier], F.array().cast("array<string>"))
        rest = F.map_filter(F.coalesce("crisis_keywords", F.create_map().cast("map<string,array<string>>")), lambda k, _: k != tier)
        out = out.withColumn("crisis_keywords", F.map_concat(rest, F.create_map(F.lit(tier), F.concat(now, F.array_except(F.array(*[F.lit(w) for w in words]), now)))))
    if idioms is not None:
        new = small(idioms.withColumnsRenamed({c: f"new_{c}" for c in idioms.columns if c != "id"}), UPDATE_BYTES)
        held = out.select("_doc", F.explode("cultural_idioms").alias("id", "v")).join(new, "id", "left")
        names = [f.split(":")[0].strip() for f in _split_fields(IDIOM)]
        merged = F.struct(*[F.coalesce(F.col(f"new_{n}"), F.col(f"v.{n}")).alias(n) if n in idioms.columns else F.col(f"v.{n}").alias(n) for n in names])
        both = held.groupBy("_doc").agg(F.map_from_entries(F.collect_list(F.struct("id", merged.alias("v")))).alias("_idioms"))
        out = out.join(both, "_doc", "left").withColumn("cultural_idioms", F.coalesce("_idioms", "cultural_idioms")).drop("_idioms")
    if meta:
        kept = F.map_filter(F.coalesce("_meta", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*meta))
        out = out.withColumn("_meta", F.map_concat(kept, F.create_map(*[F.lit(x) for pair in meta.items() for x in pair])))
    return out.withColumns(sections or {}).drop("_doc")


def _split_fields(ddl: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[at:i])
            at = i + 1
    return [*out, ddl[at:]]


def normalised(vector: Column) -> Column:
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / F.when(length > 0, length).otherwise(1.0))


def query_text(stressor: Column, emotion: Column, text: Column) -> Column:
    return F.concat_ws(" ", stressor, emotion, F.substring(text, 1, 200))


#: Queries that are sent along to all tasks, at most, or that a task holds; rows of the index that a task lets stream past such a block.
QUERY_BLOCK, INDEX_PART = 2048, 1 << 17
FOUND = "q long, w string, c long, stressor_type string, score double"


class _Nearest:
    """The `most` nearest of what streams past a block of queries (ids, wanted stressors, matrix)."""

    def __init__(self, ids: list, wanted: list, matrix: np.ndarray, most: int):
        self.ids, self.wanted, self.matrix, self.most = ids, wanted, matrix, most
        self.held: list[list[tuple]] = [[] for _ in ids]
        self.least = np.full(len(ids), -np.inf)
        self.lengths = np.sqrt((matrix * matrix).sum(1)) if len(ids) else np.zeros(0)

    def see(self, names: list, kinds: list, vectors: np.ndarray) -> None:
        """Vectors too short to reach what a query holds already are not multiplied."""
        longest = float(np.sqrt((vectors * vectors).sum(1).max())) if len(vectors) else 0.0
        open_ = np.flatnonzero(self.lengths * longest * (1 + 1e-9) + 1e-9 >= self.least)
        if not len(vectors) or not len(open_):
            return
        for i, s in zip(open_.tolist(), self.matrix[open_] @ vectors.T, strict=True):
            near = np.flatnonzero(s >= max(np.partition(s, -min(self.most, len(s)))[-min(self.most, len(s))], self.least[i]))
            self.held[i] = sorted([*self.held[i], *((-float(s[j]), names[j], kinds[j] is not None, kinds[j]) for j in near.tolist())])[: self.most]
            if len(self.held[i]) == self.most:
                self.least[i] = -self.held[i][-1][0]

    def rows(self) -> pa.RecordBatch:
        flat = [(q, w, c, kind, -s) for q, w, rows in zip(self.ids, self.wanted, self.held, strict=True) for s, c, _, kind in rows]
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([x[n] for x in flat], t) for n, t in enumerate(types)], names=["q", "w", "c", "stressor_type", "score"])


def top_k(index: DataFrame, queries: DataFrame, k: int = 3, over: int = 3, key: str = "chunk_id", query: str = "query_id", vector: str = "embedding", stressor: str = "stressor_type", wanted: str | None = None) -> DataFrame:
    """query, rank, key, score, stressor: the over * k nearest chunks by inner product, then those of the wanted stressor or none, then k.

    The filter is behind the over-fetch, as a caller may get fewer than k. wanted: the queries' column with the
    stressor; null and "none" ask for all. Ties go to the smaller key; rows that share a key each take a place. k = 0
    means 3. Vectors that are null or hold null or non-finite components take no part, nor do queries with such;
    shorter ones count as if they ended in zeros. An empty index gives no rows.

    The form goes by counted sizes. Up to QUERY_BLOCK queries are sent along, and the index is read where it lies. More
    queries are dealt into blocks and the index into parts of INDEX_PART rows, and each block meets each part in a shuffle:
    a task holds one block and lets a part stream past it, longest vectors first, so that it stops multiplying where the rest
    is too short. In both forms the index is read once, and over * k candidates a query and task are ranked behind.
    """
    k = k or 3
    unit = lambda df: df.where(usable(F.col(vector))).withColumn("v", F.transform(vector, lambda x: x.cast("double")))
    asked = unit(queries).select(F.col(query).cast("long").alias("q"), (F.col(wanted) if wanted else F.lit(None)).cast("string").alias("w"), "v")
    chunks_ = unit(index).select(F.col(key).cast("long").alias("c"), F.col(stressor).cast("string").alias("s"), "v")
    count, width = asked.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    rows, wide = chunks_.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width, most = max(width, wide), over * k
    if count <= QUERY_BLOCK:
        mine = asked.toArrow()  # QUERY_BLOCK at most
        ids, stressors, matrix = mine.column("q").to_pylist(), mine.column("w").to_pylist(), padded(mine.column("v"), width)

        def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near = _Nearest(ids, stressors, matrix, most)
            for b in batches:
                if b.num_rows:
                    near.see(b.column(0).to_pylist(), b.column(1).to_pylist(), padded(b.column(2), width))
            yield near.rows()

        found = chunks_.mapInArrow(beside, FOUND)
    else:
        blocks, parts = -(-count // QUERY_BLOCK), max(1, -(-rows // INDEX_PART))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x))
        held = asked.select(F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block"), every(parts).alias("part"), F.lit(0.0).alias("at"), F.lit(False).alias("past"), F.col("q").alias("id"), F.col("w").alias("kind"), "v")
        past = chunks_.select(every(blocks).alias("block"), F.pmod(F.xxhash64("c", "v"), F.lit(parts)).cast("int").alias("part"), (-length).alias("at"), F.lit(True).alias("past"), F.col("c").alias("id"), F.col("s").alias("kind"), "v")

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here, waiting, near = None, [], None

            def ready():
                ids, kinds, vectors = zip(*waiting, strict=True) if waiting else ((), (), ())
                return _Nearest([x for i in ids for x in i], [x for i in kinds for x in i], np.concatenate(vectors) if vectors else np.zeros((0, width)), most)

            for b in batches:
                if not b.num_rows:
                    continue
                group = b.column(0).to_numpy().astype(np.int64) << 32 | b.column(1).to_numpy()
                edges = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1), len(group)]
                for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                    if group[lo] != here:
                        if near is not None:
                            yield near.rows()
                        here, waiting, near = group[lo], [], None
                    own = lo + int((~b.column(3).slice(lo, hi - lo).to_numpy(zero_copy_only=False)).sum())
                    take = lambda a, z: (b.column(4).slice(a, z - a).to_pylist(), b.column(5).slice(a, z - a).to_pylist(), padded(b.column(6).slice(a, z - a), width))  # noqa: B023, E731
                    if own > lo:
                        waiting.append(take(lo, own))
                    if hi > own:
                        near = near or ready()
                        for at in range(own, hi, 4096):
                            near.see(*take(at, min(at + 4096, hi)))
            if near is not None:
                yield near.rows()

        found = held.unionByName(past).repartition("block", "part").sortWithinPartitions("block", "part", "past", "at").mapInArrow(meet, FOUND)
    by = Window.partitionBy("q").orderBy(F.desc("score"), "c", "stressor_type")
    found = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)
    if wanted:
        found = found.where(F.col("w").isNull() | (F.col("w") == "none") | F.col("stressor_type").isNull() | (F.col("stressor_type") == F.col("w")))
    found = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return found.select(F.col("q").alias(query), "rank", F.col("c").alias(key), "score", "stressor_type")


def context(found: DataFrame, query: str = "query_id") -> DataFrame:
    """query, context: lines `1. [source] text` of what was found, in order of rank."""
    lines = F.array_sort(F.collect_list(F.struct("rank", F.format_string("%d. [%s] %s", "rank", "source", "text").alias("line"))))
    return found.groupBy(query).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("context"))
