"""Context under a token budget: ranked chunks without repeated contents, numbered and joined."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import runs, word_count

CHUNKS = "array<struct<chunk_id:string,document_id:string,rank:int,text:string>>"
STATE = "struct<seen:array<string>,parts:array<string>,selected:array<string>,dropped:array<string>,repeated:array<string>,tokens:bigint>"


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value worked out a single time."""
    return F.element_at(F.transform(F.array(value), then), 1)


def build(chunks: Column, budget: int = 3000, deduplicate: bool = True, keep_rank_order: bool = True, count=word_count) -> Column:
    """A struct of selected, dropped and deduplicated ids, token count, truncated and final_context.

    One pass over the chunks by rank (stable; no rank comes last). A chunk whose normal form was seen is repeated, also if
    the earlier one was dropped. A chunk that would exceed the budget is dropped, but the first selected one never is,
    and later, smaller ones may still fit. count: a column function that counts the tokens of a text.
    """
    needed = lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["document_id"].alias("document_id"), c["rank"].cast("int").alias("rank"), c["text"].alias("text"))
    own = F.transform(F.transform(chunks, needed).cast(CHUNKS), lambda c, i: F.struct(F.coalesce(c["rank"].cast("double"), F.lit(1e9)).alias("r"), i.alias("i"), c.alias("c")))
    # a text is taken apart once, for its normal form and for its words
    read = lambda c: once(runs(F.lower(F.coalesce(c["text"], F.lit("")))), lambda w: F.struct(c["chunk_id"].alias("chunk_id"), c["document_id"].alias("document_id"), F.coalesce(c["text"], F.lit("")).alias("text"), F.array_join(w, " ").alias("key"), F.size(w).alias("words")))
    ordered = F.transform(F.array_sort(own) if keep_rank_order else own, lambda x: read(x["c"]))
    start = F.from_json(F.lit('{"seen":[],"parts":[],"selected":[],"dropped":[],"repeated":[],"tokens":0}'), STATE)

    def step(s: Column, c: Column) -> Column:
        def state(**new: Column) -> Column:
            return F.struct(*[new.get(n, s[n]).alias(n) for n in ("seen", "parts", "selected", "dropped", "repeated", "tokens")]).cast(STATE)

        def costed(p: Column) -> Column:
            over = (s["tokens"] + p["cost"] > budget) & (F.size(s["selected"]) > 0)
            seen = F.array_append(s["seen"], c["key"])
            taken = state(seen=seen, parts=F.array_append(s["parts"], p["piece"]), selected=F.array_append(s["selected"], c["chunk_id"]), tokens=s["tokens"] + p["cost"])
            return F.when(over, state(seen=seen, dropped=F.array_append(s["dropped"], c["chunk_id"]))).otherwise(taken)

        head = F.concat(F.lit("["), (F.size(s["selected"]) + 1).cast("string"), F.lit("] (source: "), F.coalesce(c["document_id"], F.lit("?")), F.lit(")\n"))
        # white space ends the head: its words and those of the text add up
        cost = lambda h, x: count(h) + c["words"] if count is word_count else count(x)
        told = once(head, lambda h: once(F.concat(h, c["text"]), lambda x: F.struct(x.alias("piece"), cost(h, x).cast("bigint").alias("cost"))))
        again = F.lit(deduplicate) & F.array_contains(s["seen"], c["key"])
        return F.when(again, state(repeated=F.array_append(s["repeated"], c["chunk_id"]))).otherwise(once(told, costed))

    def finish(s: Column) -> Column:
        return once(F.array_join(s["parts"], "\n\n"), lambda text: finished(s, text))

    def finished(s: Column, text: Column) -> Column:
        return F.struct(
            s["selected"].alias("selected_chunk_ids"),
            s["dropped"].alias("dropped_chunk_ids"),
            s["repeated"].alias("deduplicated_chunk_ids"),
            F.when(text == "", 0).otherwise(s["tokens"] if count is word_count else count(text)).cast("int").alias("context_token_count"),
            (F.size(s["dropped"]) > 0).alias("truncated"),
            text.alias("final_context"),
        )

    return F.aggregate(ordered, start, step, finish)


def gold_in_context(gold_ids: Column, selected_ids: Column) -> Column:
    """1 if any gold chunk was selected, else 0; null without gold."""
    return F.when(F.size(gold_ids) > 0, F.coalesce(F.arrays_overlap(gold_ids, selected_ids), F.lit(False)).cast("int"))


def rebuild(selected_ids: Column, chunks: Column) -> Column:
    """The context text of chosen ids. An id without a chunk is shown by its name and source `unknown`; of equal ids the last
    chunk counts; a chunk without a text is left out, its number isn't used again."""

    def piece(x: Column, i: Column) -> Column:
        head = lambda source: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] (source: "), source, F.lit(")\n"))
        of = lambda c: F.when(c["text"] != "", F.concat(head(F.coalesce(c["document_id"], F.lit("None"))), c["text"]))
        own = F.filter(chunks, lambda c: c["chunk_id"] == x)
        return F.when(F.coalesce(F.size(own), F.lit(0)) <= 0, F.concat(head(F.lit("unknown")), F.lit("Chunk "), x)).otherwise(of(F.element_at(own, -1)))

    return F.array_join(F.transform(selected_ids, piece), "\n\n")
