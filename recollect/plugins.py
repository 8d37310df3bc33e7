"""Stand-ins for external models: deterministic, offline, replaceable by name. Their results are stubs, not a model's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.arrays import let

_REGISTRY: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str):
    """Decorator: make a function available as ``kind`` ('extract', 'embed', 'name', 'graph') under a name."""

    def put(f: Callable) -> Callable:
        _REGISTRY[kind, name] = f
        return f

    return put


def get(kind: str, name: str) -> Callable:
    try:
        return _REGISTRY[kind, name]
    except KeyError:
        raise ValueError(f"no {kind} function named {name!r}") from None


def extractor(name: str) -> Callable[[Column], Column]:
    return get("extract", name)


@register("extract", "identity")
def identity(text: Column) -> Column:
    """Each chunk is one fact."""
    return F.array(text)


@register("embed", "hashing")
def hashing_embedding(text: Column, dims: int = 64) -> Column:
    """Counts of hashed words, to unit length by ``vectors.normalize``."""
    words = F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != "")
    counts = lambda slots: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    return let(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dims))), counts)


@register("name", "first_long_word")
def first_long_word(text: Column) -> Column:
    """A name of at most 50 characters: the longest word, first on ties; 'Sin nombre' where there is none."""
    words = F.filter(F.split(text, r"\W+"), lambda w: F.length(w) >= 4)
    longest = F.array_max(F.transform(words, lambda w: F.length(w)))
    return F.coalesce(F.substring(F.filter(words, lambda w: F.length(w) == longest)[0], 1, 50), F.lit("Sin nombre"))


@register("reply", "reply_of_longest_word")
def reply_of_longest_word(sample: Column) -> Column:
    """A reply as a naming model would give: a JSON object with the longest word of the sample, first on ties; where it has none, no JSON."""
    words = F.filter(F.split(sample, r"\W+"), lambda w: F.length(w) >= 4)
    longest = F.array_max(F.transform(words, lambda w: F.length(w)))
    return F.coalesce(F.to_json(F.struct(F.substring(F.get(F.filter(words, lambda w: F.length(w) == longest), 0), 1, 50).alias("name"))), F.lit("no name"))


@register("graph", "neighbours")
def neighbours(text: Column) -> Column:
    """struct<nodes, links>: long words are topics, each linked with the next."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) >= 8)
    nodes = F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("id"), w.alias("name"), F.lit("Topic").alias("type")))
    link = lambda a, b: F.struct(a.alias("source"), b.alias("target"), F.lit("junto_a").alias("label"))
    links = let(words, lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), link))
    return F.struct(nodes.alias("nodes"), links.alias("links"))
