"""The structure of paged documents, found with a provider's help.

A corpus is a table of pages (doc_id, page_no, text, token_count). Documents are independent and decisions within one
are sequential (a filled page is seen by the next item; a strategy that fails gives way to the next), so each document
is one group of a grouped map: its pages go in, its outline items come out. Everything before and after (page
counts, ranges, trees, texts, summaries) is relational; see quire.operators.outline.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import markdown, outline, postings
from quire.plans.provider import Provider, ask_rows, prompt, with_retries

#: Steps of progress reports.
STEPS = ("read pages", "look for contents", "read contents", "outline", "verify", "repair", "section starts", "tree", "refine", "ids", "texts", "summaries", "description")
#: An outline is taken at this accuracy, and repaired above that one.
TAKEN, REPAIRED, REPAIRS, CONTINUED = 1.0, 0.6, 3, 5


@dataclass(frozen=True)
class Options:
    toc_check_pages: int = 20
    max_pages_each_node: int = 10
    max_tokens_each_node: int = 20_000
    add_ids: bool = True
    add_summaries: bool = True
    add_description: bool = False
    add_text: bool = False


class Progress:
    """Reports the step and percent to a callback; its errors don't stop the work."""

    def __init__(self, callback: Callable[[str, int, str | None], None] | None = None, steps: tuple[str, ...] = STEPS):
        self.callback, self.steps = callback, steps

    def at(self, step: int, detail: str | None = None) -> None:
        if self.callback:
            try:
                self.callback(self.steps[step], math.floor(100 * step / max(1, len(self.steps) - 1) + 0.5), detail)
            except Exception:  # noqa: BLE001, S110  a report is no part of the result
                pass


def read_json(reply: str, default):
    """A model's JSON with fences, Python constants and trailing commas put right; the default if that fails."""
    if "```json" in reply:
        reply = reply.split("```json", 1)[1]
        reply = reply.rsplit("```", 1)[0] if "```" in reply else reply
    for a, b in (("None", "null"), ("True", "true"), ("False", "false")):
        reply = re.sub(rf"\b{a}\b", b, reply)
    for text in (reply, re.sub(r",\s*([\]}])", r"\1", reply)):
        try:
            found = json.loads(re.sub(r"\s+", " ", text.strip()))
        except ValueError:
            continue
        return found if isinstance(found, type(default)) else default
    return default


def tag_number(value) -> int | None:
    if isinstance(value, int) or value is None:
        return value
    m = re.search(r"physical_index_(\d+)", str(value))
    return int(m[1]) if m else None


def lead_number(value) -> int | None:
    if isinstance(value, int) or value is None:
        return value
    m = re.match(r"\s*([+-]?\d+)", str(value))
    return int(m[1]) if m else None


def groups_of(sizes: list[int], most: int, overlap: int = 1) -> list[list[int]]:
    """Places of pages in groups of about `most` tokens; each group repeats the last page of the one before."""
    total = sum(sizes)
    if total <= most:
        return [list(range(len(sizes)))]
    bound = math.ceil((total / math.ceil(total / most) + most) / 2)
    out, now = [], []
    for i, n in enumerate(sizes):
        if sum(sizes[k] for k in now) + n > bound:
            out.append(now)
            now = list(range(max(0, i - overlap), i))
        now.append(i)
    return [*out, now] if now else out


class Outliner:
    """One document: texts of its pages, numbered from `first`."""

    def __init__(self, ask: Provider, texts: list[str], tokens: Callable[[str], int], options: Options, first: int = 1):
        self.ask_, self.texts, self.tokens, self.o, self.first = ask, texts, tokens, options, first
        self.last = first + len(texts) - 1

    def ask(self, task: str, default, **parts):
        return read_json(self.ask_(prompt(task, **parts), None).content, default)

    def tagged(self, low: int, high: int) -> str:
        """The pages of a range with tags, clipped to the document."""
        out = ""
        for no in range(max(low, self.first), min(high, self.last) + 1):
            tag = f"<physical_index_{no}>"
            out += f"{tag}\n{self.texts[no - self.first]}\n{tag}\n\n"
        return out

    def groups(self) -> list[str]:
        tagged = [self.tagged(no, no) for no in range(self.first, self.last + 1)]
        return ["".join(tagged[i] for i in g) for g in groups_of([self.tokens(t) for t in tagged], self.o.max_tokens_each_node)]

    # Contents

    def contents_pages(self, start: int) -> list[int]:
        """Places of a run of pages of contents from a place on."""
        found: list[int] = []
        for i in range(start, len(self.texts)):
            if i >= self.o.toc_check_pages and not found:
                break
            answer = self.ask("toc-page", {}, page=self.texts[i]).get("toc_detected", "no")
            if answer == "yes":
                found.append(i)
            elif answer == "no" and found:
                break
        return found

    def contents(self) -> tuple[str, list[int], bool]:
        """The text of a table of contents, its pages, and whether it gives page numbers; one that does is preferred."""
        first, start = None, 0
        while start < min(len(self.texts), self.o.toc_check_pages) or first is None:
            places = self.contents_pages(start)
            if not places:
                break
            text = "\n".join(self.texts[i] for i in places)
            text = re.sub(r"(?:\. ){5,}\.?", ": ", re.sub(r"\.{5,}", ": ", text))
            if self.ask("toc-has-pages", {}, toc=text).get("page_index_given_in_toc", "no") == "yes":
                return text, places, True
            first = first or (text, places, False)
            start = places[-1] + 1
        return first or ("", [], False)

    def contents_items(self, toc: str) -> list[dict]:
        reply = self.ask_(prompt("toc-json", toc=toc), None).content
        for _ in range(CONTINUED):
            if self.ask("toc-complete", {}, toc=toc, outline=reply).get("completed", "no") == "yes":
                break
            cut = reply.rfind("}")
            reply = (reply[: cut + 2] if cut >= 0 else reply) + self.ask_(prompt("toc-continue", toc=toc, outline=reply), None).content
        items = read_json(reply, {}).get("table_of_contents", [])
        return [x | {"page": lead_number(x.get("page"))} for x in items if isinstance(x, dict)]

    # Strategies

    def with_page_numbers(self, toc: str, places: list[int]) -> list[dict]:
        items = self.contents_items(toc)
        start = places[-1] + 1
        pages = self.tagged(self.first + start, self.first + start + self.o.toc_check_pages - 1)
        located = self._read_items(self.ask("toc-locate", [], items=[{k: x.get(k) for k in ("structure", "title")} for x in items], pages=pages))
        pairs = [(x["page"], y["physical_index"]) for x in items for y in located if x.get("title") == y["title"] and y["physical_index"] is not None and y["physical_index"] >= start and x["page"] is not None]
        if not pairs:
            return located
        votes: dict[int, int] = {}
        for page, at in pairs:
            votes[at - page] = votes.get(at - page, 0) + 1
        met = list(votes)
        offset = min(votes, key=lambda d: (-votes[d], d < 0, d if d >= 0 else met.index(d)))
        items = [{"structure": x.get("structure"), "title": x.get("title"), "physical_index": None if x["page"] is None else x["page"] + offset} for x in items]
        for i, x in enumerate(items):  # in order: what is filled is seen by the next
            if x["physical_index"] is None:
                before = next((y["physical_index"] for y in reversed(items[:i]) if y["physical_index"] is not None), 0)
                after = next((y["physical_index"] for y in items[i + 1 :] if y["physical_index"] is not None), self.last)
                got = self._read_items(self.ask("fill-pages", [], items=[{k: x.get(k) for k in ("structure", "title")}], pages=self.tagged(before, after)))
                if got and got[0]["physical_index"] is not None:
                    x["physical_index"] = got[0]["physical_index"]
        return items

    def without_page_numbers(self, toc: str) -> list[dict]:
        items = [{k: x.get(k) for k in ("structure", "title")} for x in self.contents_items(toc)]
        for group in self.groups():
            items = self.ask("fill-pages", [], items=items, pages=group) or items
        return self._read_items(items)

    def from_text(self) -> list[dict]:
        items: list[dict] = []
        for i, group in enumerate(self.groups()):
            items += self._read_items(self.ask("structure-next", [], items=items, pages=group) if i else self.ask("structure-first", [], pages=group))
        return items

    @staticmethod
    def _read_items(items: list) -> list[dict]:
        return [{"structure": x.get("structure"), "title": x.get("title") or "", "physical_index": tag_number(x.get("physical_index"))} for x in items if isinstance(x, dict)]

    # Verification

    def holds(self, item: dict) -> bool:
        at = item["physical_index"]
        if at is None or not self.first <= at <= self.last:
            return False
        return self.ask("on-page", {}, title=item["title"], page=self.texts[at - self.first]).get("answer", "no") == "yes"

    def verify(self, items: list[dict]) -> tuple[float, list[int]]:
        known = [x["physical_index"] for x in items if x["physical_index"] is not None]
        if not known or known[-1] < len(self.texts) / 2:
            return 0.0, []
        wrong = [i for i, x in enumerate(items) if not self.holds(x)]
        return 1 - len(wrong) / len(items), wrong

    def repair(self, items: list[dict], wrong: list[int]) -> list[dict]:
        for _ in range(REPAIRS):
            if not wrong:
                break
            bad, still = set(wrong), []
            fixed = list(items)
            for i in wrong:
                sure = lambda js: next((items[j]["physical_index"] for j in js if j not in bad and items[j]["physical_index"] is not None), None)  # noqa: B023, E731
                low, high = sure(range(i - 1, -1, -1)), sure(range(i + 1, len(items)))
                pages = self.tagged(self.first - 1 if low is None else low, self.last if high is None else high)
                at = tag_number(self.ask("find-start", {}, title=items[i]["title"], pages=pages).get("physical_index"))
                if at is not None and self.holds(items[i] | {"physical_index": at}):
                    fixed[i] = items[i] | {"physical_index": at}
                else:
                    still.append(i)
            items, wrong = fixed, still
        return items

    def ladder(self, mode: str, toc: str, places: list[int]) -> list[dict]:
        """Items by a strategy; one whose pages prove wrong too often gives way to the next."""
        below = {"with-pages": "without-pages", "without-pages": "from-text"}
        items = {"with-pages": lambda: self.with_page_numbers(toc, places), "without-pages": lambda: self.without_page_numbers(toc), "from-text": self.from_text}[mode]()
        items = [x | {"physical_index": None if x["physical_index"] is not None and x["physical_index"] > self.last else x["physical_index"]} for x in items if x["physical_index"] is not None]
        accuracy, wrong = self.verify(items)
        if accuracy >= TAKEN and not wrong:
            return items
        if accuracy > REPAIRED:
            return self.repair(items, wrong)
        if mode in below:
            return self.ladder(below[mode], toc, places)
        raise ValueError("no strategy gave an outline of these pages")

    def items(self) -> list[dict]:
        """The outline: located items with a preface where the first starts late, and whether each starts its page."""
        toc, places, numbered = self.contents()
        items = self.ladder("with-pages" if toc and numbered else "from-text", toc, places)
        if items and items[0]["physical_index"] is not None and items[0]["physical_index"] > self.first:
            items = [{"structure": "0", "title": "Preface", "physical_index": self.first}, *items]
        return self._with_starts(items)

    def _with_starts(self, items: list[dict]) -> list[dict]:
        out = []
        for x in items:
            at, answer = x["physical_index"], "no"
            if at is not None and self.first <= at <= self.last:
                answer = self.ask("starts-page", {}, title=x["title"], page=self.texts[at - self.first]).get("start_begin", "no")
            out.append(x | {"appear_start": answer})
        return [x for x in out if x["physical_index"] is not None]

    def refined(self, items: list[dict], within: int | None = None) -> list[dict]:
        """Items with those of large sections put in below them, in place of any there, level by level.

        within: pages of the section that the items are from; a section as long as that isn't taken apart again.
        """
        out: list[dict] = []
        gone = ""  # the code of a section that was taken apart: its former parts go
        for i, x in enumerate(items):
            code = str(x["structure"] or "")
            if gone and code.startswith(f"{gone}."):
                continue
            gone = ""
            nxt = items[i + 1] if i + 1 < len(items) else None
            end = self.last if nxt is None else nxt["physical_index"] - (nxt["appear_start"] == "yes")
            out.append(x)
            low = x["physical_index"]
            size = sum(self.tokens(t) for t in self.texts[low - self.first : end - self.first + 1])
            if end - low <= self.o.max_pages_each_node or size < self.o.max_tokens_each_node or end - low + 1 == within:
                continue
            part = Outliner(self.ask_, self.texts[low - self.first : end - self.first + 1], self.tokens, self.o, low)
            try:
                below = part._with_starts(part.ladder("from-text", "", []))
            except ValueError:
                continue
            if below and below[0]["title"].strip() == x["title"].strip():
                below = below[1:]
            below = [y | {"structure": f"{x['structure']}.{y['structure'] or k}"} for k, y in enumerate(below, 1)]
            out += part.refined(below, end - low + 1)
            gone = code
        return out


_ITEMS = "doc_id {}, list_index int, structure string, title string, physical_index int, appear_start string"


def outline_items(pages: DataFrame, provider: Provider, options: Options = Options(), counter: Callable[[str], int] | None = None) -> DataFrame:
    """Outline items of every document of a table of pages. A document without an outline gives no rows."""
    kind = pages.schema["doc_id"].dataType.simpleString()
    count = counter or (lambda t: -(-len(t) // 4))

    def one(part: pa.Table) -> pa.Table:
        rows = sorted(zip(part.column("page_no").to_pylist(), part.column("text").to_pylist(), strict=True))
        outliner = Outliner(with_retries(provider), [t or "" for _, t in rows], count, options)
        try:
            items = outliner.refined(outliner.items())
        except ValueError:
            items = []
        ids = pa.array([part.column("doc_id")[0].as_py()] * len(items), part.schema.field("doc_id").type)
        text = lambda k: pa.array([None if x[k] is None else str(x[k]) for x in items], pa.string())
        return pa.table({"doc_id": ids, "list_index": pa.array(range(len(items)), pa.int32()), "structure": text("structure"), "title": text("title"), "physical_index": pa.array([x["physical_index"] for x in items], pa.int32()), "appear_start": text("appear_start")})

    return pages.select("doc_id", "page_no", "text").groupBy("doc_id").applyInArrow(one, _ITEMS.format(kind))


def build(pages: DataFrame, provider: Provider, write: Callable[[DataFrame, str], DataFrame], options: Options = Options(), progress: Progress | None = None) -> DataFrame:
    """Nodes of every document: pages to a tree with ranges, ids, texts and summaries.

    write(df, name) stores a table and returns it read again: replies are paid for once.
    """
    p = progress or Progress()
    p.at(1)
    items = write(outline_items(pages, provider, options), "items")
    counts = pages.groupBy("doc_id").agg(F.max("page_no").cast("int").alias("n_pages"))
    p.at(7)
    nodes = outline.with_paths(outline.with_parents(outline.ranges(items, counts)))
    parents = nodes.select("doc_id", F.col("parent_index").alias("list_index")).where("list_index is not null").distinct().withColumn("inner", F.lit(True))
    nodes = nodes.join(parents, ["doc_id", "list_index"], "left").withColumn("is_leaf", F.col("inner").isNull()).drop("inner")
    if options.add_text or options.add_summaries:
        p.at(10)
        nodes = nodes.join(outline.range_text(nodes, pages), ["doc_id", "list_index"])
    if options.add_summaries:
        p.at(11)
        asked = nodes.withColumn("prompt", F.concat(F.lit(prompt("summary", title="\x01", text="\x02").split("\x01")[0]), "title", F.lit("\n## text\n"), "text"))
        nodes = write(ask_rows(asked, provider, out="summary").drop("prompt"), "summaries")
    if not options.add_text and "text" in nodes.columns:
        nodes = nodes.drop("text")
    return nodes if options.add_ids else nodes.drop("node_id")


@dataclass(frozen=True)
class MarkdownOptions:
    thin: bool = False
    min_tokens: int = 5000
    summary_tokens: int = 200
    add_ids: bool = True
    add_summaries: bool = True
    add_description: bool = False
    add_text: bool = False


#: Steps of progress reports over Markdown.
MARKDOWN_STEPS = ("start", "headings", "section texts", "thinning", "tree", "summaries", "description", "done")


def index_markdown(docs: DataFrame, provider: Provider | None, write: Callable[[DataFrame, str], DataFrame], options: MarkdownOptions = MarkdownOptions(), progress: Progress | None = None) -> DataFrame:
    """Nodes of Markdown texts (doc_id, content): sections, thinned if asked, as a tree with ids, paths, texts and summaries.

    write(df, name) stores a table and returns it read again: replies are paid for once. With add_description, each node
    carries its document's description, which needs summaries.
    """
    if options.add_summaries and provider is None:
        raise ValueError("summaries need a provider")
    p = progress or Progress(steps=MARKDOWN_STEPS)
    p.at(1)
    nodes = markdown.sections(docs)
    p.at(2)
    if options.thin:
        p.at(3)
        nodes = markdown.thin(markdown.with_tree(nodes), options.min_tokens).drop("subtree_tokens")
    p.at(4)
    nodes = write(markdown.with_paths(markdown.with_tree(nodes)), "markdown-tree")
    if options.add_ids:
        nodes = markdown.with_ids(nodes)
    if options.add_summaries:
        p.at(5)
        head = prompt("summary", title="\x01", text="\x02").split("\x01")[0]
        long = outline.X.token_count(F.col("text")) >= options.summary_tokens
        asked = nodes.withColumn("prompt", F.when(long, F.concat(F.lit(head), "title", F.lit("\n## text\n"), "text")))
        nodes = markdown.summary_columns(write(ask_rows(asked, provider, out="reply"), "replies"), F.col("reply"), options.summary_tokens).drop("prompt", "reply")
        if options.add_description:
            p.at(6)
            nodes = nodes.join(write(descriptions(nodes, provider), "descriptions"), "doc_id", "left")
    p.at(7)
    return nodes if options.add_text else nodes.drop("text")


def reverse_index(nodes: DataFrame, mode: str = "keyword", provider: Provider | None = None, per_node: int = 10, min_length: int = 3) -> DataFrame:
    """Postings of nodes: by the words they hold (keyword) or by a provider's terms (llm)."""
    if mode not in ("keyword", "llm"):
        raise ValueError(f"the mode {mode!r} is not known")
    if mode == "keyword":
        return postings.build_keywords(nodes, per_node, min_length)
    if provider is None:
        raise ValueError("the mode 'llm' needs a provider")
    return postings.build_from_terms(concept_terms(nodes, provider, per_node))


def checked_input(kind: str, content: object) -> object:
    """The content of a document, if it is of the type that its format needs."""
    if kind == "md" and not (isinstance(content, str) and content):
        raise ValueError("Markdown needs a text that is not empty")
    if kind in ("pdf", "docx", "xlsx") and not isinstance(content, (bytes, bytearray, memoryview)):
        raise ValueError(f"{kind} needs bytes")
    if kind == "csv" and not isinstance(content, (str, bytes, bytearray, memoryview)):
        raise ValueError("csv needs a text or bytes")
    return content


def descriptions(nodes: DataFrame, provider: Provider) -> DataFrame:
    """doc_id and a sentence about it, from its tree's titles and summaries; asked where summaries were made."""
    fields = [c for c in ("title", "node_id", "summary", "prefix_summary") if c in nodes.columns]
    trees = nodes.groupBy("doc_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("node_seq", F.struct(*fields).alias("n")))), lambda x: x.n)).alias("tree"))
    head = prompt("description", tree="\x01").split("\x01")[0]
    asked = trees.withColumn("prompt", F.concat(F.lit(head), F.replace("tree", F.lit('":"'), F.lit('": "'))))
    return ask_rows(asked, provider, out="doc_description").select("doc_id", "doc_description")


def concept_terms(nodes: DataFrame, provider: Provider, most: int = 10) -> DataFrame:
    """Nodes with an array of terms from a provider, for postings.build_from_terms; failed calls give none."""
    body = F.coalesce(*(F.col(c) for c in ("summary", "prefix_summary", "text") if c in nodes.columns), F.lit(""))
    head = prompt("concepts", most=most, title="\x01").split("\x01")[0]
    text = F.when((F.col("title") != "") | (body != ""), F.concat(F.lit(head), F.coalesce("title", F.lit("")), F.lit("\n## text\n"), body))
    from quire.operators.postings import llm_terms

    asked = ask_rows(nodes.withColumn("prompt", text), provider, on_error="")
    return asked.withColumn("terms", llm_terms(F.col("reply"), most)).drop("prompt", "reply")


def nested(nodes: list[dict]) -> list[dict]:
    """The nested form of one document's flat nodes (list_index, parent_index, ...), for export."""
    made = {n["list_index"]: {k: v for k, v in n.items() if k not in ("list_index", "parent_index", "path", "node_seq") and v is not None} for n in nodes}
    roots = []
    for n in sorted(nodes, key=lambda n: n["list_index"]):
        up = made.get(n["parent_index"])
        (up.setdefault("nodes", []) if up is not None else roots).append(made[n["list_index"]])
    return roots


def document_type(name: str | None, kind: str | None = None) -> str:
    """The format of a document by its name, or as given."""
    ext = {"xls": "xlsx", "ods": "xlsx", "markdown": "md"}.get(e := (name or "").rsplit(".", 1)[-1].lower(), e)
    if kind or ext in ("pdf", "docx", "csv", "xlsx", "md"):
        return kind or ext
    raise ValueError(f"the format of {name!r} is not known")


__all__ = ["MarkdownOptions", "Options", "Outliner", "Progress", "build", "checked_input", "concept_terms", "descriptions", "document_type", "index_markdown", "nested", "outline_items", "reverse_index"]
