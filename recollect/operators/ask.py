"""Decisions by a model that may fail: prompts in batches, one client a worker, errors beside the rows they befell."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import confirmed
from .classify import HI, LO, scores

#: Makes a client; a client turns a list of prompts into as many replies, or raises.
Make = Callable[[], Callable[[list[str]], list[str]]]
NONE, ERROR = "NINGUNO", 500


def asked(df: DataFrame, prompt: str, make: Make, batch: int = 20, name: str = "model") -> DataFrame:
    """df with ``reply`` and ``error``: what the client answers to the column ``prompt``.

    A worker makes its client once for all its tasks under ``name`` (again if making it fails). Prompts go in batches; if a batch fails its prompts are asked one by one, and only a prompt
    that fails alone has an error and no reply. Null prompts are not asked. Both functions are shipped with the job.
    """
    schema = df.select("*", F.lit(None).cast("string").alias("reply"), F.lit(None).cast("string").alias("error")).schema
    at = df.columns.index(prompt)

    def one(client, text: str) -> tuple[str | None, str | None]:
        try:
            (reply,) = client([text])
            return reply, None
        except Exception as e:  # that prompt's error
            return None, f"{type(e).__name__}: {e}"[:ERROR]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = sys.modules.setdefault("_recollect_clients", types.ModuleType("_recollect_clients")).__dict__
        for b in batches:
            told: list[tuple[str | None, str | None]] = [(None, None)] * b.num_rows
            some = [(k, t) for k, t in enumerate(b.column(at).to_pylist()) if t is not None]
            for s in range(0, len(some), batch):
                part = some[s : s + batch]
                try:
                    client = kept.get(name) or kept.setdefault(name, make())
                except Exception as e:  # no client: every prompt of the batch has that error
                    answers = [(None, f"{type(e).__name__}: {e}"[:ERROR])] * len(part)
                else:
                    try:
                        replies = client([t for _, t in part])
                        answers = [(r, None) for r in replies] if len(replies) == len(part) else [one(client, t) for _, t in part]
                    except Exception:
                        answers = [one(client, t) for _, t in part]
                for (k, _), a in zip(part, answers, strict=True):
                    told[k] = a
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([t[i] for t in told], pa.string()) for i in (0, 1)]], names=[*b.schema.names, "reply", "error"])

    return df.mapInArrow(run, schema)


def yes(reply: Column) -> Column:
    """A reply that begins with SÍ or SI, in either case; none is no."""
    said = F.upper(F.trim(reply))
    return F.coalesce(said.startswith("SÍ") | said.startswith("SI"), F.lit(False))


def several_prompt(text: Column, candidates: Column) -> Column:
    """Which of several labels (array of name, space_id) a text belongs to."""
    listed = F.array_join(F.transform(candidates, lambda c: F.concat(F.lit("- "), c["name"], F.lit(": "), c["space_id"])), "\n")
    return F.concat(F.lit('Recuerdo: "'), text, F.lit('"\n\nEspacios:\n'), listed, F.lit(f"\n\nResponde solo con los IDs separados por coma, o {NONE}."))


def one_prompt(text: Column, name: Column, space_id: Column) -> Column:
    return F.concat(F.lit('Recuerdo: "'), text, F.lit('"\n\nEspacio: "'), name, F.lit('" ('), space_id, F.lit(")\n\nResponde SÍ o NO."))


def assign_asked(items: DataFrame, spaces: DataFrame, make: Make, hi: float = HI, lo: float = LO) -> DataFrame:
    """(id, space_ids, error): labels of the upper band, then those of the middle band that the model names, each in label order.

    items: (id, user_id, vector, text); spaces: (space_id, user_id, description_vector, name). One prompt an item with all its candidates; a reply of
    ``NINGUNO``, of other labels or of none confirms nothing, and neither does an error, which is told. Items without any label or error are left out.
    """
    found = scores(items, spaces, hi, lo).where("band <> 'none'").join(spaces.select("space_id", "name"), "space_id")
    entry = F.struct("space_id", F.col("space_id").cast("string").alias("key"), "name")
    pick = lambda band: F.array_sort(F.collect_list(F.when(F.col("band") == band, entry)))
    each = found.groupBy("id").agg(pick("auto").alias("auto"), pick("candidate").alias("candidates")).join(items.select("id", "text"), "id")
    names = F.transform("candidates", lambda c: F.struct(c["name"], c["key"].alias("space_id")))
    prompts = each.withColumn("prompt", F.when(F.size("candidates") > 0, several_prompt(F.coalesce("text", F.lit("")), names)))
    keys = lambda c: F.transform(c, lambda x: x["key"])
    told = asked(prompts, "prompt", make).withColumn("yes", F.when(F.col("reply").isNull() | (F.trim("reply") == NONE), F.array().cast("array<string>")).otherwise(confirmed(keys("candidates"), F.coalesce("reply", F.lit("")))))
    return told.select("id", F.concat(keys("auto"), "yes").alias("space_ids"), "error").where((F.size("space_ids") > 0) | F.col("error").isNotNull())


def confirmed_pairs(pairs: DataFrame, items: DataFrame, spaces: DataFrame, make: Make) -> DataFrame:
    """The pairs (space_id, id, ...) to which the model says yes, one prompt each; an error is a no."""
    texts, names = items.select("id", F.coalesce("text", F.lit("")).alias("_text")), spaces.select("space_id", F.col("name").alias("_name"))
    prompts = pairs.join(texts, "id").join(names, "space_id").select(*pairs.columns, one_prompt(F.col("_text"), F.col("_name"), F.col("space_id").cast("string")).alias("_prompt"))
    return asked(prompts, "_prompt", make).where(yes(F.col("reply"))).select(*pairs.columns)
