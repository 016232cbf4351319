"""Main text of web pages: structure first, then the strings that a host's pages share.

Elements that never hold the article are left out by name, role or class. The blocks that remain of a
page are concatenated to one token stream, and each place of it gets the hash of the ``run`` tokens from
there on. A string that a good share of a host's pages hold is boilerplate: the tokens that it covers
go where they reach a bound of their block, and the unique runs of the block stay; inside a sentence they are
quotations and stay. Blocks that shorter common strings cover from end to end, and short blocks common as
they are, go as well. A page on which no unique run of ``run`` tokens would stay is a copy of others, edited here
and there perhaps, and stays whole.

Pages are counted over the whole host. A host of more than SHARD_PAGES pages is dealt out in shards: what the
share of its pages hold, the same share of a shard's pages hold in one shard at least. So each shard
names what is common in it, and only those strings are counted again, by all pages of the host. Pages are read and parsed
for each of these steps: strings and counts are written, page bodies are not.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import materialize, small_batches

SHARD_PAGES = 64
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "select", "title", "object", "canvas"}
#: Of these, elements that a slash before the > ends.
FOREIGN = {"svg", "object", "iframe"}
RAW_ENDS = {name: re.compile(rf"</{name}\s*(?:>|\Z)", re.I) for name in RAW}
NOISE = RAW | {"annotation", "annotation-xml", "head", "nav", "footer", "aside", "form", "button", "dialog", "menu", "fieldset", "label", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = set(
    "a abbr b bdi bdo big br cite code data dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr del "
    "math semantics mfrac mi mn mo mover mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover".split()
)
NOISE_WORDS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related "
    "replies share sharing sidebar signup skip social sponsor sponsored subscribe toc toolbar widget".split()
)
#: Words that may stand beside those in a name; any other word ("ad-hoc-analysis", "social-security") makes it an article's own.
BESIDE_WORDS = set(
    "area bar body bottom box btn button buttons col column container content desktop fixed global header inner item items js left link links list "
    "main mobile module outer overlay page panel post posts right rail row secondary section site slot sticky top ui unit wrap wrapper zone".split()
)
#: Their ids are link targets within an article, not names of parts of the page.
FLOW = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "tr", "blockquote", "pre", "figure", "figcaption", "a", "span"}
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*))?")
WORDS = re.compile(r"[a-z0-9]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _attributes(text: str) -> dict[str, str]:
    """Values by name, both in small letters; of equal names the first counts."""
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), value.strip("\"'").lower())
    return found


def _tells_noise(name: str) -> bool:
    """Whether a class or id is made of words for parts beside the article, and of words that go with them."""
    words = [word for word in WORDS.findall(name) if len(word) > 1 and not word.isdigit()]
    return any(word in NOISE_WORDS for word in words) and all(word in NOISE_WORDS or word in BESIDE_WORDS for word in words)


def _is_noise(name: str, attributes: dict[str, str], in_article: bool) -> bool:
    if name in NOISE or (name == "header" and not in_article):
        return True
    told = attributes.get("class", "").split() + (attributes.get("id", "").split() if name not in FLOW else [])
    if name in ("html", "body", "article", "main") and not any(x in ("comment", "comments") for n in told for x in WORDS.findall(n)):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role") in NOISE_ROLES:
        return True
    return any(_tells_noise(one) for one in told)


def page_blocks(page: str) -> list[str]:
    """Text blocks of the article (of the main element or the body if there is none), in page order."""
    stack: list[tuple[str, bool, str]] = []  # open elements: name, whether left out, kind
    whole: list[tuple[str, bool, bool]] = []  # text, in an article, in a main element
    pending: list[str] = []
    skipped = articles = mains = 0
    at = 0
    endless: set[str] = set()  # raw elements that no end tag follows any more

    def flush() -> None:
        if pending:
            block = " ".join(html.unescape("".join(pending)).split())
            pending.clear()
            if block:
                whole.append((block, articles > 0, mains > 0))

    while tag := TAG.search(page, at):
        if not skipped and tag.start() > at:
            pending.append(page[at : tag.start()])
        at = tag.end()
        name = tag[2]
        if name is None:
            continue
        name = name.lower()
        if name in RAW:  # goes up to its end tag, or is empty without one
            empty = name in endless or (name in FOREIGN and tag[3].rstrip().endswith("/"))
            if not tag[1] and not empty:
                end = RAW_ENDS[name].search(page, at)
                if end:
                    at = end.end()
                else:
                    endless.add(name)
            continue
        if name not in INLINE:
            flush()
        elif name == "br":
            pending.append(" ")
        if tag[1]:
            depth = next((n for n in range(len(stack) - 1, -1, -1) if stack[n][0] == name), None)
            if depth is None:
                continue
            flush_needed = any(entry[1] or entry[2] for entry in stack[depth:])
            if flush_needed:
                flush()
            for entry in stack[depth:]:
                skipped -= entry[1]
                articles -= entry[2] == "article"
                mains -= entry[2] == "main"
            del stack[depth:]
        elif name not in VOID and not tag[3].rstrip().endswith("/"):
            if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and stack and stack[-1][0] == name:
                skipped -= stack.pop()[1]
            attributes = _attributes(tag[3])
            noise = _is_noise(name, attributes, articles > 0)
            if noise:
                flush()
            kind = "" if noise else "article" if name == "article" else "main" if name == "main" or attributes.get("role") == "main" else ""
            stack.append((name, noise, kind))
            skipped += noise
            articles += kind == "article"
            mains += kind == "main"
    if not skipped and at < len(page):
        pending.append(page[at:])
    flush()
    for level in (1, 2):
        if any(entry[level] for entry in whole):
            return [entry[0] for entry in whole if entry[level]]
    return [entry[0] for entry in whole]


def page_strings(blocks: list[str], run: int) -> tuple[np.ndarray, list[int]]:
    """64-bit hashes of a page's strings, and how many there are of each kind.

    First come the strings of 4 tokens (``run`` if less) and of ``run`` tokens at each place of the page's
    token stream, which runs on over the blocks; then each block too short for those, by itself.
    """
    short = min(run, 4)
    words = [block.split() for block in blocks]
    tokens = np.array([xxhash.xxh64_intdigest(word) for block in words for word in block], dtype=np.uint64)
    kinds = []
    for length in (short, run):
        values = np.zeros(max(0, len(tokens) - length + 1), dtype=np.uint64)
        for n in range(length if len(values) else 0):
            values = values * _BASE + tokens[n : len(values) + n]
        values = (values ^ (values >> np.uint64(32))) * (_BASE + np.uint64(2 * length))
        kinds.append(values ^ (values >> np.uint64(29)))
    kinds.append(np.array([xxhash.xxh64_intdigest(" ".join(block), 1) for block in words if len(block) < short], dtype=np.uint64))
    return np.concatenate(kinds).view(np.int64), [len(kind) for kind in kinds]


def strings_on_pages(pages: list[np.ndarray], needed: int) -> np.ndarray:
    """Those strings that at least ``needed`` of the pages hold."""
    if len(pages) < needed:
        return np.array([], dtype=np.int64)
    values, counts = np.unique(np.concatenate([np.unique(page) for page in pages]), return_counts=True)
    return values[counts >= needed]


def without_strings(blocks: list[str], strings: np.ndarray, kinds: list[int], common: np.ndarray, run: int) -> list[str]:
    """A page without what its common strings cover.

    Covered runs of ``run`` tokens and more go if they begin or end their block, and the rest of the block stays.
    Blocks that shorter strings cover from end to end go as well, as do short blocks that are common as they are.
    Where no ``run`` tokens in a row are the page's own, it stays whole.
    """
    short = min(run, 4)
    known = np.isin(strings, common)
    if not known.any():
        return blocks
    words = [block.split() for block in blocks]
    size = sum(map(len, words))
    masks, at = [], 0
    for length, count in zip((short, run), kinds, strict=False):
        edges = np.zeros(size + 1, dtype=np.int64)
        starts = np.flatnonzero(known[at : at + count])
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + length, -1)
        masks.append(np.cumsum(edges[:-1]) > 0)
        at += count
    runs, either = masks[1], masks[0] | masks[1]
    alone = iter(known[at:].tolist())
    kept, gone, at = [], np.zeros(size, dtype=bool), 0
    for block, own in zip(blocks, words, strict=True):
        part = slice(at, at + len(own))
        at += len(own)
        whole = len(own) < short and next(alone)
        if whole or either[part].all():
            gone[part] = True
        elif runs[part].any():
            unique = np.flatnonzero(~runs[part])
            first = unique[0] if len(unique) else len(own)
            last = unique[-1] + 1 if len(unique) else len(own)
            gone[part.start : part.start + first] = gone[part.start + last : part.stop] = True
            kept.append(" ".join(own[first:last]))
        else:
            kept.append(block)
    bounds = np.flatnonzero(np.diff(np.concatenate([[True], gone | runs, [True]])))
    longest = (bounds[1::2] - bounds[::2]).max(initial=0)
    return kept if longest >= run else blocks


def _share_of(pages: int, share: float) -> int:
    return int(np.ceil(share * pages - 1e-9))


def without_boilerplate(blocks: list[list[str]], run: int, share: float, least: int) -> list[list[str]]:
    """The blocks of each page of a host, without boilerplate."""
    strings = [page_strings(page, run) for page in blocks]
    common = strings_on_pages([values for values, _ in strings], max(least, _share_of(len(blocks), share)))
    return [without_strings(page, *found, common, run) for page, found in zip(blocks, strings, strict=True)]


def main_text(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    body: str = "html",
    run: int = 8,
    share: float = 0.5,
    least: int = 3,
) -> DataFrame:
    """key, url, text and n_chars (code points), a row per row of ``pages``.

    Null or empty html, and pages of nothing but boilerplate markup, give empty text. Pages without a
    host in their url are one host, of any number of pages. Repeated rows are pages of their own. A host of fewer than ``least``
    pages keeps every block. An empty table gives an empty table.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^\s*(?:[A-Za-z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    # as a stored table its size is known, so Spark broadcasts it only if it is small
    sizes = materialize(pages.groupBy(host.alias("_h")).agg(F.count(F.lit(1)).alias("_pages")).coalesce(1), "host-pages")

    draw = F.xxhash64("_key", "_url")
    named = small_batches(pages).select(F.col(key).cast("long").alias("_key"), F.col(url).cast("string").alias("_url"), host.alias("_host"), F.col(body).cast("string").alias("_body"))
    sharded = named.join(sizes, F.col("_host") == F.col("_h")).withColumn(
        "_shard", F.pmod(draw, F.ceil(F.col("_pages") / F.lit(SHARD_PAGES)).cast("long"))
    )

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parsed = [page_blocks(page or "") for page in batch.pop("_body")]
            yield batch.assign(_blocks=parsed)

    def judge(group: pd.DataFrame) -> pd.DataFrame:
        """Strings common in a shard; a host of one shard is judged as a whole."""
        total, blocks = int(group["_pages"].iloc[0]), [list(b) for b in group["_blocks"]]
        needed = max(least if total <= SHARD_PAGES else 1, _share_of(len(blocks), share))
        found = strings_on_pages([page_strings(page, run)[0] for page in blocks], needed)
        return pd.DataFrame({"_h": group["_host"].iloc[0], "_string": found})

    parsed = sharded.select("_host", "_shard", "_pages", "_body").mapInPandas(parse, "_host string, _shard long, _pages long, _blocks array<string>")
    found = parsed.groupBy("_host", "_shard").applyInPandas(judge, "_h string, _string long")
    asked = materialize(found.groupBy("_h").agg(F.collect_set("_string").alias("_asked")), "html-asked")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, group in batch.groupby("_host"):
                strings = np.sort(np.asarray(group["_asked"].iloc[0], dtype=np.int64))
                holders = np.zeros(len(strings), dtype=np.int64)
                for page in group["_body"]:
                    holders += np.isin(strings, page_strings(page_blocks(page or ""), run)[0])
                yield pd.DataFrame({"_h": name, "_string": strings, "_n": holders})

    named_asked = named.join(asked, F.col("_host") == F.col("_h")).select("_host", "_body", "_asked")
    counts = named_asked.mapInPandas(count, "_h string, _string long, _n long").groupBy("_h", "_string").agg(F.sum("_n").alias("_n"))
    total = sizes.select(F.col("_h").alias("_name"), "_pages")
    needed = F.greatest(F.lit(least), F.ceil(F.lit(float(share)) * F.col("_pages") - F.lit(1e-9)))
    kept = counts.join(total, F.col("_h") == F.col("_name")).where(F.col("_n") >= needed)
    common = materialize(kept.groupBy("_h").agg(F.collect_list("_string").alias("_common")), "html-common")

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for page, strings in zip(batch.pop("_body"), batch.pop("_common"), strict=True):
                blocks = page_blocks(page or "")
                if strings is not None:
                    blocks = without_strings(blocks, *page_strings(blocks, run), np.asarray(strings, dtype=np.int64), run)
                texts.append("\n\n".join(blocks))
            yield batch.assign(_text=texts)

    joined = named.join(common, F.col("_host") == F.col("_h"), "left").select("_key", "_url", "_body", "_common")
    made = joined.mapInPandas(clean, "_key long, _url string, _text string")
    return made.select(F.col("_key").alias(key), F.col("_url").alias(url), F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))
