"""Main text of web pages by deducing the template of each host from equivalence classes of tokens.

1. A page's tokens are its tags and the words of its text, each told apart by the block
   elements around it (names, classes and ids), so that one word in a menu and in a heading
   are two tokens. In an article, of which nothing less than a block is ever left out, the
   text of a block is one token.
2. Tokens of one host with the same occurrence vector over its pages are one class. Vectors are
   never gathered: a token has the number of its pages and a sum of hashes of (page, count),
   which combine before the exchange, so a host with a third of all pages is not one task's.
   Only tokens of most pages of a host are kept after that.
3. The order of a class is that of its tokens' summed positions. In a page a class is valid if
   its tokens come in that order, once or as often as the class repeats, and all in one gap of
   the class that every page has once. Valid classes, nested in those gaps, are the template.
4. What lies in the gaps is the slots. A slot's text is kept if it belongs to the article: not
   in menus, headers, footers, asides, forms, notices, adverts, scripts or reader comments, and
   in an ``article`` or ``main`` element if the page has one with text. Without one, words of
   the template are left out, and what remains in slots is the text. In an article, a block
   of two words or more is left out if it is in the template, once on every page of the host.

A host needs ``least_pages`` pages of different content for a template, as copies of one page
have everything in common; else, and without a host in the url, only the elements count.

Cases: null and empty html give empty text and 0; a page that ends early, unclosed or stray
tags, and comments, quotes or scripts that are never closed are read as far as they go; repeated
rows and rows that share an id give a row each; a null id or url stays; empty tables give an
empty result; other columns are not read. A page is held whole, in its own row.
"""

from __future__ import annotations

import functools
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import per_batch, stored
from .page_blocks import Block, blocks

HASHED = (1 << 63) - 1
#: Hashes of (page, count) are of 30 bits, so that the sum over eight thousand million pages fits a long.
MIXED = (1 << 30) - 1
#: Token of the page itself, which every page of a host has once; the page's content is a token below it.
PAGE = 0


@dataclass(frozen=True)
class Settings:
    """share: of a host's pages that a template token is in, at least; least_pages: different pages that a host must have;
    broadcast_bytes: templates of up to this size go to every task, beyond it they are joined by host, dealt by ``salts``.
    """

    share: float = 0.5
    least_pages: int = 5
    broadcast_bytes: int = 16 << 20
    salts: int = 32


@functools.lru_cache(maxsize=1 << 16)
def token(path: int, word: str = "") -> int:
    """Number of a tag, or of a word under it; never that of the page."""
    return xxhash.xxh3_64_intdigest(f"{path} {word}") & HASHED | 1


def text_tokens(b: Block) -> list[int]:
    """Tokens of a block's text, in order."""
    words = b.words
    return [token(b.path, " ".join(words))] if b.article and words else [token(b.path, w) for w in words]


def _sited(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id, url, site (hash of the host, null without one), html."""
    host = F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.when(host != "", F.xxhash64(host)).alias("site"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))


def _occurrences(pages: DataFrame) -> DataFrame:
    """site, token, page (hash of id and content), count, place (of the first one), for each token of a page, the page and its content."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sites, found, keys, counts, places = [], [], [], [], []
        for i, site, page in zip(*(batch.column(c).to_pylist() for c in ("page_id", "site", "html"))):
            content = xxhash.xxh3_64_intdigest(page) & HASHED
            order = page_tokens(*blocks(page))
            held = Counter(order)
            n = len(held) + 2
            sites += [site] * n
            keys += [xxhash.xxh3_64_intdigest(f"{i} {content}") & HASHED] * n
            found += [PAGE, -content - 1, *held]
            counts += [1, 1, *held.values()]
            first = dict(zip(reversed(order), range(len(order) - 1, -1, -1)))
            places += [0, 0, *(first[t] for t in held)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (sites, found, keys, counts, places)], names=["site", "token", "page", "count", "place"])

    return per_batch(pages.where("site IS NOT NULL AND html <> ''"), run, "site long, token long, page long, count long, place long")


def classes(pages: DataFrame, settings: Settings) -> DataFrame:
    """site, token, class, rank, everywhere: tokens of most pages of a host, by occurrence vector, in order; everywhere: once on every page."""
    seen = _occurrences(pages)
    mixed = F.xxhash64("page", "count").bitwiseAND(MIXED)
    by_token = seen.groupBy("site", "token").agg(F.count("*").alias("pages"), F.sum(mixed).alias("mix"), F.max("count").alias("most"), F.sum("place").alias("places"))
    kept = stored(by_token.where((F.col("pages") >= settings.least_pages) | (F.col("token") < PAGE)), "page-tokens")
    hosts = kept.where(F.col("token") <= PAGE).groupBy("site").agg(F.max(F.when(F.col("token") == PAGE, F.col("pages"))).alias("all_pages"), F.count(F.when(F.col("token") < PAGE, 1)).alias("contents"))
    most = kept.where(F.col("token") > PAGE).join(hosts.where(F.col("contents") >= settings.least_pages), "site").where(F.col("pages") >= settings.share * F.col("all_pages"))
    in_class = Window.partitionBy("site", "class").orderBy("places", "token")  # as many rows as a template has tokens
    return most.withColumn("class", F.xxhash64("pages", "mix")).select("site", "token", "class", (F.row_number().over(in_class) - 1).alias("rank"), ((F.col("pages") == F.col("all_pages")) & (F.col("most") == 1)).alias("everywhere"))


def _with_templates(pages: DataFrame, members: DataFrame, settings: Settings) -> DataFrame:
    """Pages with t, the template tokens of their host (null without a template)."""
    per_site = members.groupBy("site").agg(F.collect_list(F.struct("token", "class", "rank", "everywhere")).alias("t"))
    per_site = per_site.select("site", *(F.col(f"t.{c}").alias(f"t_{c}") for c in ("token", "class", "rank", "everywhere")))
    if members.count() * 32 <= settings.broadcast_bytes:
        return pages.join(F.broadcast(per_site), "site", "left")
    salted = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(settings.salts)))
    spread = per_site.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(settings.salts - 1)).cast("array<long>")))
    return salted.join(spread, ["site", "salt"], "left").drop("salt")


def page_tokens(found: list[Block], tags: list[int]) -> list[int]:
    """Tokens of a page in order, each tag before the first block under it."""
    out: list[int] = []
    left = iter(tags)
    opened: set[int] = set()
    for b in found:
        while b.path not in opened and (tag := next(left, None)) is not None:
            opened.add(tag)
            out.append(token(tag))
        out += text_tokens(b)
    return out + [token(t) for t in left]


def valid_here(order: list[int], members: dict[int, tuple[int, int, bool]]) -> dict[int, bool]:
    """token -> everywhere, of the classes that are valid in a page; members: token -> (class, rank, everywhere)."""
    ranks: dict[int, list[int]] = {}
    gaps: dict[int, set[int]] = {}
    size = Counter(group for group, _, _ in members.values())
    gap = 0  # tokens so far of what every page has once
    for t in order:
        if t in members:
            group, rank, everywhere = members[t]
            ranks.setdefault(group, []).append(rank)
            gaps.setdefault(group, set()).add(0 if everywhere else gap)
            gap += everywhere
    valid = {g for g, seen in ranks.items() if len(gaps[g]) == 1 and all(r == k % size[g] for k, r in enumerate(seen)) and len(seen) % size[g] == 0}
    return {t: everywhere for t, (group, _, everywhere) in members.items() if group in valid}


def main_text(found: list[Block], template: dict[int, bool]) -> str:
    """The article's blocks joined by a space; template: token -> whether every page has it once."""
    held = [(b, b.words) for b in found if b.kept]
    inside = [(b, w) for b, w in held if b.article and w]
    out: list[str] = []
    for b, words in inside or held:
        if not template:
            out += words
        elif inside:
            if not (len(words) > 1 and template.get(token(b.path, " ".join(words)), False)):
                out += words
        else:
            out += [w for w in words if token(b.path, w) not in template]
    return " ".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", settings: Settings = Settings()) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    sited = _sited(pages, id_col, url_col, html_col)
    members = stored(classes(sited, settings), "page-classes")
    kinds = {f.name: f.dataType.simpleString() for f in sited.schema.fields}

    def text_of(page: str, t: list | None, group: list | None, rank: list | None, everywhere: list | None) -> str:
        found, tags = blocks(page)
        return main_text(found, valid_here(page_tokens(found, tags), dict(zip(t, zip(group, rank, everywhere)))) if t else {})

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [text_of(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("html", "t_token", "t_class", "t_rank", "t_everywhere")))]
        text = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), text, pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return per_batch(_with_templates(sited, members, settings), run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
