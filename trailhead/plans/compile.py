"""A parsed query as columns: every leaf is one over a chunk, the tree a boolean over the leaves.

Without an index the leaves are computed from the chunks' tokens in one scan; with one they are looked up (seek), and
only chunks that may match are joined to it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions import languages as L
from ..functions import text as X
from ..operators import filters as FI
from ..operators import merge as M
from ..sources import postings as PO
from . import language as Q
from . import seek as SK

MOST_EXPANSIONS = 24


@dataclass
class Leaf:
    kind: str
    text: str
    expansions: list[str] = field(default_factory=list)
    rejected: list[str] = field(default_factory=list)
    retrievers: list[str] = field(default_factory=list)


@dataclass
class Plan:
    """The compiled query: candidates, and what its leaves are."""

    canonical: str
    language: str
    leaves: list[Leaf]
    matched: DataFrame  # all chunks in scope, at least those that a leaf matches, with a column for each leaf's match
    candidates: DataFrame

    def explain(self) -> DataFrame:
        """Matches of each leaf, before the tree is applied: leaf, kind, text, matches."""
        counts = self.matched.agg(*(F.count_if(F.col(f"m{i}")).alias(f"m{i}") for i in range(len(self.leaves))))
        rows = F.array(*(F.struct(F.lit(i).alias("leaf"), F.lit(x.kind).alias("kind"), F.lit(x.text).alias("text"), F.col(f"m{i}").alias("matches")) for i, x in enumerate(self.leaves)))
        return counts.select(F.inline(rows))


def term_words(term: str, adapter: L.Adapter, rejected: list[str], most: int) -> tuple[dict[str, bool], Leaf]:
    """Normal forms to match, each with whether it is an expansion."""
    leaf = Leaf("term", term, retrievers=["term"])
    words = {adapter.norm_word(term): False}
    for x in adapter.expand(term):
        if len(leaf.expansions) >= most:
            break
        if x in rejected:
            leaf.rejected.append(x)
        elif adapter.norm_word(x) not in words:
            words[adapter.norm_word(x)] = True
            leaf.expansions.append(x)
    return words, leaf


def _term(words: dict[str, bool], reasons: list[str]) -> tuple[Column, Column, Column, Column]:
    """Matches, first match (token number), and the contribution of a word leaf."""
    wanted = F.array(*map(F.lit, words))
    hits = F.filter("norms", lambda t: F.array_contains(wanted, t))
    first = F.try_element_at(hits, F.lit(1))
    expanded = [w for w, via in words.items() if via]
    via = first.isin(expanded) if expanded else F.lit(False)
    why = F.concat(F.array(F.lit("token_term")), F.when(via, F.array(F.lit("wordform_expand"))).otherwise(F.array().cast("array<string>")), F.array(*map(F.lit, reasons)).cast("array<string>"))
    return F.size(hits) > 0, F.array_position(F.col("norms"), first) - 1, F.lit(1), M.contribution("term", F.size(hits), F.lit(1.0), why)


def _found_term(i: int, reasons: list[str]) -> tuple[Column, Column, Column, Column]:
    """As _term, from what the index has of a leaf."""
    why = F.concat(F.array(F.lit("token_term")), F.when(F.col(f"v{i}"), F.array(F.lit("wordform_expand"))).otherwise(F.array().cast("array<string>")), F.array(*map(F.lit, reasons)).cast("array<string>"))
    return F.col(f"c{i}") > 0, F.col(f"f{i}"), F.lit(1), M.contribution("term", F.col(f"c{i}"), F.lit(1.0), why)


def _seeks(index: PO.Index, nodes: list[Q.Node], terms: dict[int, tuple[dict[str, bool], Leaf]], adapter: L.Adapter) -> list[SK.Seek] | None:
    """What each leaf asks the index for; None if one of them can only be found by a scan."""
    out = []
    for i, n in enumerate(nodes):
        if isinstance(n, Q.Term):
            s = SK.term(index, terms[i][0], adapter)
        elif n.morph:
            words = _split(n.text)
            s = SK.morph_phrase(index, words, adapter) if words else SK.Seek((frozenset(),))
        else:
            s = SK.phrase(index, n.text)
        if s is None:
            return None
        out.append(s)
    return out


def _sequence(lemmas: list[list[str]]) -> Column:
    """Number of the first token from which consecutive tokens share a lemma with each word; null without."""
    starts = F.sequence(F.lit(1), F.greatest(F.size("lemma_sets") - len(lemmas) + 1, F.lit(1)))
    fits = lambda i: [F.arrays_overlap(F.get("lemma_sets", i + j - 1), F.array(*map(F.lit, x))) for j, x in enumerate(lemmas)]

    def all_fit(i: Column) -> Column:
        out = F.lit(True)
        for c in fits(i):
            out = out & c
        return out

    enough = F.size("lemma_sets") >= len(lemmas)
    return F.when(enough, F.try_element_at(F.filter(starts, all_fit), F.lit(1)) - 1)


def compile_query(
    chunks: DataFrame, query: str, language: str = "", f: FI.Filters = FI.Filters(), rejected: list[str] | None = None, most_expansions: int = MOST_EXPANSIONS, sparse_terms: bool = False,
    index: PO.Index | None = None,
) -> Plan:
    """Candidates of a query over chunks in scope.

    A directive in the query outranks the language given. With sparse_terms, a chunk that a word leaf matches gets a
    sparse contribution for the word too. index is the positional index of the chunks' snapshot: the same rows, from
    its blocks. Without it, or where a phrase can only be found by a scan (no words in it, or more words of the snapshot
    hold a piece of it than seek.MOST_WORDS), the leaves are computed from the texts.
    """
    parsed = Q.parse(query)
    lang = parsed.language or language
    adapter = L.adapter(lang)
    nodes = Q.leaves(parsed.root)
    codes = f.reasons()
    base = chunks.where(FI.condition(f))
    terms = {i: term_words(n.text, adapter, rejected or [], most_expansions) for i, n in enumerate(nodes) if isinstance(n, Q.Term)}
    seeks = _seeks(index, nodes, terms, adapter) if index else None
    if seeks is None:
        base = base.withColumn("words", X.raw_tokens(F.col("text")))
        base = base.withColumn("norms", F.transform("words", adapter.norm))
        if any(isinstance(n, Q.Phrase) and n.morph for n in nodes):
            base = _with_lemmas(base, adapter)
    described: list[Leaf] = []
    columns: dict[str, Column] = {}
    sides: list[tuple[Column, Column]] = []  # contribution, struct<first token, tokens, byte>
    for i, n in enumerate(nodes):
        if isinstance(n, Q.Term):
            words, leaf = terms[i]
            leaf.kind = "morph_term" if n.morph else "term"
            match, first, many, c = _found_term(i, codes) if seeks else _term(words, codes)
            parts = [c]
            if sparse_terms:
                leaf.retrievers.append("sparse")
                low = F.lower("text").contains(n.text.lower())
                parts.append(M.contribution("sparse", F.lit(1.0), F.lit(0.0), ["sparse_overlap", *codes]))
                both = F.when(low, F.array(*parts)).otherwise(F.array(c))
            else:
                both = F.array(c)
        elif n.morph:
            words = [w for w in _split(n.text)]
            leaf = Leaf("morph_phrase", n.text, retrievers=["morphphrase"])
            many = F.lit(max(len(words), 1))
            if seeks:
                first = F.col(f"f{i}")
            else:
                first = _sequence([adapter.lemma_words(w) for w in words]) if words else F.lit(None).cast("int")
            match, both = first.isNotNull(), F.array(M.contribution("morphphrase", F.lit(1.0), F.lit(1.0), ["morph_phrase", "lemma_match", *codes]))
        else:
            leaf = Leaf("phrase", n.text, retrievers=["exact"])
            match, first, many = F.col("text").contains(n.text), F.lit(None).cast("int"), F.lit(0)
            if seeks:
                match = (F.col(f"c{i}") > 0) & match
            both = F.array(M.contribution("exact", F.lit(1.0), F.lit(1.0), ["exact_phrase", *codes]))
        described.append(leaf)
        columns[f"m{i}"] = F.coalesce(match, F.lit(False))
        columns[f"f{i}"] = first.cast("int")
        sides.append((both, many))
    if seeks:
        joined = lambda root: base.join(SK.evaluate(index, seeks, root, nodes).withColumnRenamed("chunk_id", "_id"), F.col("chunk_id").cast("string") == F.col("_id")).drop("_id").withColumns(columns)
        any_leaf, base = joined(None), joined(parsed.root)
        matched = base.withColumn("_row", F.lit(0))
    else:
        matched = any_leaf = None
    # a row number keeps the filter above the leaves: pushed below, it would compute each leaf once more, and its tokens
    # once for each use
    if matched is None:
        matched = any_leaf = base.withColumns({**columns, "_row": F.monotonically_increasing_id()})
    number = {id(n): i for i, n in enumerate(nodes)}

    def match(node: Q.Node) -> Column:
        if isinstance(node, Q.Term | Q.Phrase):
            return F.col(f"m{number[id(node)]}")
        if isinstance(node, Q.Not):
            return ~match(node.child)
        out = match(node.children[0])
        for c in node.children[1:]:
            out = (out & match(c)) if isinstance(node, Q.And) else (out | match(c))
        return out

    empty = F.array().cast(f"array<{schema.CONTRIBUTION}>")

    def contributions(node: Q.Node) -> Column:
        if isinstance(node, Q.Term | Q.Phrase):
            return sides[number[id(node)]][0].cast(f"array<{schema.CONTRIBUTION}>")
        if isinstance(node, Q.And):
            return F.concat(*(contributions(c) for c in node.children if not isinstance(c, Q.Not)))
        return F.concat(*(F.when(match(c), contributions(c)).otherwise(empty) for c in node.children))

    def snippets(node: Q.Node) -> list[Column]:
        """Byte span of each leaf that may be shown, in order; null where it doesn't match."""
        if isinstance(node, Q.Not):
            return []
        if isinstance(node, Q.Term | Q.Phrase):
            i = number[id(node)]
            if isinstance(node, Q.Phrase) and not node.morph:
                at = X.byte_position(F.col("text"), node.text)
                span = F.struct(at.alias("start"), (at + len(node.text.encode())).alias("end"))
            else:
                span = X.nth_token_span(F.col("text"), F.col(f"f{i}"), sides[i][1])
            return [F.when(F.col(f"m{i}"), span)]
        return [s for c in node.children for s in snippets(c)]

    out = matched.where(match(parsed.root) & (F.col("_row") >= 0)).withColumn("contributions", contributions(parsed.root))
    out = M.scored(out.withColumn("match_span", F.coalesce(*snippets(parsed.root))))
    keep = ["chunk_id", "source_id", "span_start", "span_end", "text", "text_checksum", "trust_level", "contributions", "merged_score", "priority", "reasons", "match_span"]
    return Plan(Q.canonical(parsed.root), lang, described, any_leaf, out.select(*keep))


def _split(text: str) -> list[str]:
    import regex

    return regex.findall(X.WORD, text)


def _with_lemmas(base: DataFrame, adapter: L.Adapter) -> DataFrame:
    """Add lemma_sets, in order of the tokens.

    Lemmas that need Arrow are looked up for the distinct words of a chunk, then spread over its tokens.
    """
    if adapter is not L.RUSSIAN:
        return base.withColumn("lemma_sets", F.transform("words", adapter.lemmas))
    return base.withColumn("lemma_sets", _lemma_sets(F.col("words")))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _lemma_sets(words):
    known: dict[str, list[str]] = {}

    def of(word: str) -> list[str]:
        if word not in known:
            known[word] = L.RUSSIAN.lemma_words(word)
        return known[word]

    return words.map(lambda ws: [of(w) for w in ws] if ws is not None else [])
