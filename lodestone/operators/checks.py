"""Rules over frontmatter, external urls, rich-text trees and snippets: rows out are findings or facts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import status_ok
from lodestone.operators.query import field_value


def frontmatter_rules(documents: DataFrame, rules: list[dict]) -> DataFrame:
    """path, rule, message for documents with frontmatter (JSON text) that break a rule.

    Rules: {required: key}, {prohibited: key}, {type: label, key}, {allowed: [values], key},
    {pattern: regex, key}, {unique: key}. A key that is absent breaks required only.
    """
    value = field_value
    text = lambda k: F.try_variant_get(value(k), "$", "string")
    out = None
    for r in rules:
        key = r.get("key") or r.get("required") or r.get("prohibited") or r.get("unique")
        base = documents.where("frontmatter is not null")
        if "unique" in r:
            kind = F.schema_of_variant(value(key))
            bad = base.where(value(key).isNotNull()).withColumn("_n", F.count("*").over(Window.partitionBy(kind, text(key)))).where("_n > 1").drop("_n")
            rule, message = "unique", f"{key} is not unique"
        else:
            cond: Column
            if "required" in r:
                cond, rule, message = value(key).isNull(), "required", f"{key} is missing"
            elif "prohibited" in r:
                cond, rule, message = value(key).isNotNull(), "prohibited", f"{key} is not allowed"
            elif "type" in r:
                cond, rule, message = value(key).isNotNull() & (type_label(value(key)) != r["type"]), "type", f"{key} is no {r['type']}"
            elif "allowed" in r:
                cond, rule, message = value(key).isNotNull() & ~F.coalesce(text(key).isin(*r["allowed"]), F.lit(False)), "allowed", f"{key} has another value"
            elif "pattern" in r:
                cond, rule, message = value(key).isNotNull() & ~F.coalesce(text(key).rlike(r["pattern"]), F.lit(False)), "pattern", f"{key} does not match"
            else:
                raise ValueError(f"unknown rule {r}")
            bad = base.where(cond)
        found = bad.select("path", F.lit(rule).alias("rule"), F.lit(message).alias("message"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no rules")
    return out


def type_label(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return F.when(kind == "VOID", "null").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "BIGINT", "integer").otherwise("number")


def url_findings(links: DataFrame, status: DataFrame, allowed: list[int] = (), ttl_ms: int | None = None, now_ms: int = 0) -> DataFrame:
    """Occurrences of external links whose url failed. Each url is looked up once, then joined back; answers older than ttl do not count."""
    urls = links.where("external").select(F.col("target").alias("url")).distinct()
    fresh = status if ttl_ms is None else status.where((now_ms - F.col("checked_ms") >= 0) & (now_ms - F.col("checked_ms") < ttl_ms))
    judged = urls.join(fresh.select("url", "status"), "url").where(~F.coalesce(status_ok(F.col("status"), list(allowed)), F.lit(False)))
    return links.where("external").join(judged.withColumnRenamed("url", "target"), "target").select("path", "line", "target", "status")


#: How a rich text's nodes and marks get to Markdown: exact, approximate, or not at all, as types that are not named. Fixed values.
NODE_FIDELITY = {
    "exact": ("doc", "paragraph", "text", "heading", "hardBreak", "rule", "blockquote", "bulletList", "orderedList", "listItem", "codeBlock"),
    "approximate": (
        "table", "tableRow", "tableCell", "tableHeader", "taskList", "taskItem", "panel", "expand", "nestedExpand", "mediaSingle", "mediaGroup", "media", "mediaInline",
        "decisionList", "decisionItem", "layoutSection", "layoutColumn", "inlineCard", "blockCard", "embedCard", "mention", "emoji", "status", "date",
    ),
    "unsupported": ("placeholder", "extension", "bodiedExtension", "inlineExtension", "multiBodiedExtension", "extensionFrame"),
}
EXACT_MARKS = ("strong", "em", "code", "strike", "link")
KNOWN_NODES = tuple(t for types in NODE_FIDELITY.values() for t in types)


def rich_nodes(trees: DataFrame) -> DataFrame:
    """path, node_id, parent_id, depth, type, marks of every node of JSON trees (path, tree), in document order."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for path, tree in zip(pdf["path"], pdf["tree"], strict=True):
                stack, n = [(json.loads(tree), -1, 0)] if tree else [], 0
                while stack:
                    node, parent, depth = stack.pop()
                    out.append((path, n, parent, depth, node.get("type"), [m.get("type") for m in node.get("marks") or []], node.get("text")))
                    stack += [(c, n, depth + 1) for c in reversed(node.get("content") or [])]
                    n += 1
            yield pd.DataFrame(out, columns=["path", "node_id", "parent_id", "depth", "type", "marks", "text"])

    return trees.select("path", "tree").mapInPandas(run, "path string, node_id long, parent_id long, depth int, type string, marks array<string>, text string")


def rich_inventory(nodes: DataFrame) -> DataFrame:
    """kind (node or mark), type, count, fidelity (exact, approximate, unsupported)."""
    n = nodes.groupBy(F.lit("node").alias("kind"), "type").agg(F.count("*").alias("count"))
    m = nodes.select(F.explode("marks").alias("type")).groupBy(F.lit("mark").alias("kind"), "type").agg(F.count("*").alias("count"))
    node = F.when(F.col("type").isin(*NODE_FIDELITY["exact"]), "exact").when(F.col("type").isin(*NODE_FIDELITY["approximate"]), "approximate").otherwise("unsupported")
    mark = F.when(F.col("type").isin(*EXACT_MARKS), "exact").otherwise("unsupported")
    return n.unionByName(m).withColumn("fidelity", F.when(F.col("kind") == "mark", mark).otherwise(node))


#: What may stand where in rich text: children by parent; parents that need one; the one that may have one only. Fixed values.
INLINE = ("text", "hardBreak", "emoji", "mention", "date", "status", "inlineCard", "placeholder", "mediaInline", "inlineExtension")
BLOCKS = ("paragraph", "heading", "codeBlock", "rule", "blockquote", "bulletList", "orderedList", "panel", "table", "mediaSingle", "mediaGroup", "taskList", "decisionList", "expand")
IN_CELLS = (*[t for t in BLOCKS if t not in ("table", "expand")], "nestedExpand")
CONTENT = {
    "doc": BLOCKS,
    "paragraph": INLINE,
    "heading": INLINE,
    "codeBlock": ("text",),
    "rule": (),
    "blockquote": ("paragraph", "codeBlock", "bulletList", "orderedList", "mediaSingle", "mediaGroup"),
    "bulletList": ("listItem",),
    "orderedList": ("listItem",),
    "listItem": ("paragraph", "codeBlock", "bulletList", "orderedList", "mediaSingle", "taskList"),
    "table": ("tableRow",),
    "tableRow": ("tableCell", "tableHeader"),
    "tableCell": IN_CELLS,
    "tableHeader": IN_CELLS,
    "panel": ("paragraph", "heading", "codeBlock", "rule", "bulletList", "orderedList", "mediaSingle", "mediaGroup", "taskList", "decisionList"),
    "expand": (*[t for t in BLOCKS if t != "expand"], "nestedExpand"),
    "nestedExpand": tuple(t for t in IN_CELLS if t != "nestedExpand"),
    "taskList": ("taskItem", "taskList"),
    "taskItem": INLINE,
    "decisionList": ("decisionItem",),
    "decisionItem": INLINE,
    "mediaSingle": ("media",),
    "mediaGroup": ("media",),
    "media": (),
}
NEED_CONTENT = ("blockquote", "bulletList", "orderedList", "listItem", "table", "tableCell", "tableHeader", "panel", "expand", "nestedExpand", "taskList", "decisionList", "mediaSingle", "mediaGroup")
ONE_CHILD = ("mediaSingle",)


def rich_findings(nodes: DataFrame) -> DataFrame:
    """path, node_id, type, parent_type, finding of nodes of rich text that break the content model.

    Findings: not-allowed (the parent may not hold it), too-few and too-many (children),
    unknown (a type that nobody knows; at the top that is all that is said of it), no-doc
    (a root of another type) and marked-code (marks on the text of a code block).
    """
    up = nodes.select("path", F.col("node_id").alias("parent_id"), F.col("type").alias("parent_type"))
    inner = nodes.where("parent_id >= 0").join(up, ["path", "parent_id"])
    held = F.create_map(*[x for p, own in CONTENT.items() for x in (F.lit(p), F.array(*[F.lit(c) for c in own]).cast("array<string>"))])
    allowed = F.try_element_at(held, F.col("parent_type"))
    known = F.coalesce(F.col("type").isin(*KNOWN_NODES), F.lit(False))
    at_top = F.col("parent_type") == "doc"
    finding = F.filter(
        F.array(
            F.when(allowed.isNotNull() & ~F.coalesce(F.array_contains(allowed, F.col("type")), F.lit(False)) & ~(at_top & ~known), "not-allowed"),
            F.when(~known, "unknown"),
            F.when((F.col("parent_type") == "codeBlock") & (F.size("marks") > 0), "marked-code"),
        ),
        lambda x: x.isNotNull(),
    )
    placed = inner.select("path", "node_id", "type", "parent_type", F.explode(finding).alias("finding"))
    count = nodes.where("parent_id >= 0").groupBy("path", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n"))
    bounded = nodes.where(F.col("type").isin(*NEED_CONTENT)).join(up, ["path", "parent_id"], "left")
    sized = bounded.join(count, ["path", "node_id"], "left")
    number = F.when(F.col("n").isNull(), "too-few").when(F.col("type").isin(*ONE_CHILD) & (F.col("n") > 1), "too-many")
    sized = sized.select("path", "node_id", "type", "parent_type", number.alias("finding")).where("finding is not null")
    roots = nodes.where("parent_id < 0 and (type is null or type <> 'doc')").select("path", "node_id", "type", F.lit(None).cast("string").alias("parent_type"), F.lit("no-doc").alias("finding"))
    return placed.unionByName(sized).unionByName(roots)


def _inline(node: dict) -> str:
    if node.get("type") == "hardBreak":
        return "  \n"
    text = node.get("text", "")
    for m in node.get("marks") or []:
        kind = m.get("type")
        text = {"strong": f"**{text}**", "em": f"*{text}*", "code": f"`{text}`", "strike": f"~~{text}~~", "link": f"[{text}]({(m.get('attrs') or {}).get('href', '')})"}.get(kind, text)
    return text


def rich_to_markdown(tree: str | None) -> str:
    """Blocks apart by blank lines; unknown blocks give their text."""

    def block(node: dict, indent: str = "") -> list[str]:
        kind, kids, attrs = node.get("type"), node.get("content") or [], node.get("attrs") or {}
        line = lambda: "".join(_inline(k) for k in kids)
        if kind == "heading":
            return ["#" * int(attrs.get("level", 1)) + " " + line()]
        if kind == "paragraph":
            return [line()]
        if kind == "codeBlock":
            return [f"```{attrs.get('language') or ''}\n{line()}\n```"]
        if kind == "rule":
            return ["---"]
        if kind == "blockquote":
            return ["\n".join("> " + x for b in kids for y in block(b) for x in y.split("\n"))]
        if kind in ("bulletList", "orderedList"):
            rows = []
            for n, item in enumerate(kids):
                mark = "- " if kind == "bulletList" else f"{int(attrs.get('order', 1)) + n}. "
                body = "\n".join(x for b in item.get("content") or [] for x in block(b))
                rows.append(mark + body.replace("\n", "\n" + " " * len(mark)))
            return ["\n".join(rows)]
        if kind == "table":
            cells = [[" ".join(x for b in c.get("content") or [] for x in block(b)).replace("|", "\\|") for c in r.get("content") or []] for r in kids]
            if not cells:
                return []
            head = ["| " + " | ".join(cells[0]) + " |", "|" + " --- |" * len(cells[0])]
            return ["\n".join(head + ["| " + " | ".join(r) + " |" for r in cells[1:]])]
        if kids:
            return [x for k in kids for x in ([_inline(k)] if k.get("type") == "text" else block(k))]
        return [_inline(node)] if "text" in node else []

    return "\n\n".join(block(json.loads(tree))) if tree else ""


def to_markdown(trees: DataFrame) -> DataFrame:
    convert = F.pandas_udf(lambda s: s.map(rich_to_markdown), T.StringType())
    return trees.select("path", convert("tree").alias("markdown"))


def dedent(lines: list[str]) -> list[str]:
    """Without the blanks that all lines with text begin with."""
    own = [len(x) - len(x.lstrip(" \t")) for x in lines if x.strip()]
    cut = min(own, default=0)
    return [x[cut:] if x.strip() else "" for x in lines]


def extract_region(source: str, name: str) -> tuple[str, str | None]:
    """(ok, text) between '#region name' and '#endregion' (name may follow), or a reason: missing, unclosed, repeated, empty."""
    lines = source.split("\n")
    opens = [k for k, x in enumerate(lines) if x.split()[-2:] == ["#region", name] or x.strip().endswith(f"#region {name}")]
    if not opens:
        return "missing", None
    if len(opens) > 1:
        return "repeated", None
    depth = 0
    for k in range(opens[0] + 1, len(lines)):
        if "#region" in lines[k]:
            depth += 1
        elif "#endregion" in lines[k]:
            if depth == 0:
                body = dedent([x for x in lines[opens[0] + 1 : k] if "#region" not in x and "#endregion" not in x])
                return ("ok", "\n".join(body)) if any(x.strip() for x in body) else ("empty", None)
            depth -= 1
    return "unclosed", None


def snippet_state(code: Column, source: Column) -> Column:
    """current or stale, after line ends, blanks at line ends and blank last lines are put aside; unresolved without a source."""
    clean = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "\r\n", "\n"), r"(?m)[ \t]+$", ""), r"\n+$", "")
    return F.when(source.isNull(), "unresolved").when(clean(code) == clean(source), "current").otherwise("stale")
