"""Markdown documents as relations: one pass per document, nested columns, exploded on demand.

The parser reads lines: frontmatter, ATX and setext headings, fenced and indented code,
inline and reference links, images, task items and pipe tables. Nothing inside code or
frontmatter is looked at. Slugs are numbered in heading order, which needs the whole
document, so this is an Arrow function; all that follows is plain DataFrame work.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = """path string, n_lines int, frontmatter_status string, frontmatter string, frontmatter_end int, words int, paragraphs int, lists int,
headings array<struct<line:int,depth:int,text:string,slug:string>>,
links array<struct<line:int,text:string,target:string,image:boolean,external:boolean,anchor:boolean,kind:string,destination_line:int,start:int,end:int>>,
tasks array<struct<line:int,checked:boolean,text:string>>,
code_blocks array<struct<line:int,end_line:int,language:string,meta:string,content:string>>,
tables array<struct<line:int,end_line:int,n_columns:int,n_rows:int,headers:array<string>,align:array<string>>>,
math array<struct<line:int,end_line:int>>,
tree array<struct<line:int,depth:int,text:string,slug:string,parent:string,parents:array<string>,ordinal:int,last_line:int>>"""

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*([^\s`]*)\s*([^`]*)$")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_TASK = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+\[([ xX])\]\s+(.*)$")
_BREAK = re.compile(r"^ {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_QUOTE = re.compile(r"^(?: {0,3}> ?)+")
_ITEM = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+")
_DEFINITION = re.compile(r"^ {0,3}\[([^\]]+)\]:\s*<?([^\s>]+)>?")
_INLINE = re.compile(r"(!?)\[((?:[^\[\]]|\[[^\]]*\])*)\]\(\s*(?:<(?P<angle>[^<>\n]*)>|(?P<bare>(?:[^\s()<]|\([^\s()]*\))*))(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)")
_REFERENCE = re.compile(r"(!?)\[([^\[\]]+)\](?:\[([^\[\]]*)\])?(?![(:\[])")
_CODE_SPAN = re.compile(r"(`+)(.+?)\1(?!`)")
_DELIMITER = re.compile(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")
_EXTERNAL = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]+:|//)")


def slug_of(text: str) -> str:
    """Lower case, letters, digits, hyphens and underscores; blanks become hyphens."""
    return "".join("-" if c == " " else c for c in text.lower() if c.isalnum() or c in " -_")


def plain_text(text: str) -> str:
    """The words of inline markup."""
    text = _INLINE.sub(lambda m: "" if m[1] else m[2], text)
    text = _CODE_SPAN.sub(lambda m: m[2], text)
    return re.sub(r"(\*\*|__|\*|~~)(.+?)\1", r"\2", text).strip()


@lru_cache(1)
def _yaml_loader():
    """Loads YAML 1.2's core schema: yes, no, on and dates are strings, 012 is twelve, a key that comes twice is an error."""
    import yaml

    class Core(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        yaml_implicit_resolvers: dict = {}

        def construct_mapping(self, node, deep=False):
            seen = set()
            for key, _ in node.value:
                if isinstance(key, yaml.ScalarNode) and (own := self.construct_object(key)) is not None:
                    if own in seen:
                        raise yaml.constructor.ConstructorError(None, None, f"the key {own!r} comes twice", key.start_mark)
                    seen.add(own)
            return super().construct_mapping(node, deep)

    def number(loader, node):
        text = node.value.lower()
        return int(text, 0) if text.startswith(("0o", "0x")) else int(text)

    def real(loader, node):
        return float(node.value.lower().replace(".inf", "inf").replace(".nan", "nan"))

    rules = {
        "bool": (r"true|True|TRUE|false|False|FALSE", "tTfF"),
        "null": (r"~|null|Null|NULL|", ["~", "n", "N", ""]),
        "int": (r"[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+", "-+0123456789"),
        "float": (r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)", "-+0123456789."),
    }
    for name, (pattern, first) in rules.items():
        Core.add_implicit_resolver(f"tag:yaml.org,2002:{name}", re.compile(f"(?:{pattern})\\Z"), list(first))
    Core.add_constructor("tag:yaml.org,2002:int", number)
    Core.add_constructor("tag:yaml.org,2002:float", real)
    return Core


def front_matter(lines: list[str]) -> tuple[str, str | None, int]:
    """(missing | malformed | non-mapping | valid, JSON of a mapping, lines that it takes)."""
    if not lines or lines[0].removesuffix("\r") != "---":
        return "missing", None, 0
    end = next((k for k in range(2, len(lines)) if lines[k].removesuffix("\r").rstrip(" \t") in ("---", "...")), None)
    if end is None:
        return "malformed", None, 0
    import yaml

    source = "\n".join(lines[1:end])
    try:
        data = yaml.load(source, _yaml_loader()) if source.strip() else {}  # a safe loader
    except (yaml.YAMLError, ValueError):
        return "malformed", None, end + 1
    if not isinstance(data, dict):
        return "non-mapping", None, end + 1
    return "valid", json.dumps(data, default=str, ensure_ascii=False), end + 1


def _cells(line: str) -> list[str]:
    return [c.strip() for c in re.split(r"(?<!\\)\|", line.strip().strip("|"))]


def _tree(headings: list[dict], n_lines: int) -> list[dict]:
    """The headings nested by depth: parent (slug), parents (texts from the top), ordinal among siblings, last line with all below.

    A depth that is skipped gets no level of its own.
    """
    out: list[dict] = []
    above: list[dict] = []  # the open headings, of growing depth
    for h in headings:
        before = None
        while above and above[-1]["depth"] >= h["depth"]:
            before = above.pop()
            before["last_line"] = h["line"] - 1
        ordinal = before["ordinal"] + 1 if before and before["depth"] == h["depth"] else 0
        out.append(h | {"parent": above[-1]["slug"] if above else None, "parents": [x["text"] for x in above], "ordinal": ordinal, "last_line": n_lines})
        above.append(out[-1])
    return out


def parse(content: str) -> dict:
    lines = content.split("\n")
    status, data, start = front_matter(lines)
    out: dict = {"n_lines": len(lines), "frontmatter_status": status, "frontmatter": data, "frontmatter_end": start, "headings": [], "links": [], "tasks": [], "code_blocks": [], "tables": [], "math": []}
    slugs: dict[str, int] = {}
    offsets = [0]  # where each line begins, in characters
    for line in lines:
        offsets.append(offsets[-1] + len(line) + 1)
    text_lines: list[tuple[int, str, int]] = []  # line, text, where it begins in the line
    definitions: dict[str, tuple[str, int, int, int]] = {}  # target, its line and span
    paragraphs = lists = words = 0
    in_paragraph = in_list = False
    k = start

    def heading(at: int, depth: int, raw: str, column: int) -> None:
        text = " ".join(plain_text(raw).split("\n"))
        slug = slug_of(text)
        n = slugs.get(slug, 0)
        slugs[slug] = n + 1
        if n:
            slug = f"{slug}-{n}"
            slugs.setdefault(slug, 1)
        out["headings"].append({"line": at + 1, "depth": depth, "text": text, "slug": slug})
        text_lines.append((at, raw, column))

    while k < len(lines):
        line = lines[k]
        if m := _FENCE.match(line):
            end = k + 1
            close = re.compile(rf"^ {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}\s*$")
            while end < len(lines) and not close.match(lines[end]):
                end += 1
            out["code_blocks"].append({"line": k + 1, "end_line": min(end + 1, len(lines)), "language": m[2] or None, "meta": m[3].strip() or None, "content": "\n".join(lines[k + 1 : end])})
            in_paragraph = in_list = False
            k = end + 1
            continue
        if line.strip() == "$$":
            end = next((j for j in range(k + 1, len(lines)) if lines[j].strip() == "$$"), len(lines) - 1)
            out["math"].append({"line": k + 1, "end_line": end + 1})
            in_paragraph = in_list = False
            k = end + 1
            continue
        if not line.strip():
            in_paragraph = in_list = False
            k += 1
            continue
        if line.startswith(("    ", "\t")) and not in_paragraph and not in_list:
            end = k
            while end + 1 < len(lines) and (lines[end + 1].startswith(("    ", "\t")) or not lines[end + 1].strip()):
                end += 1
            while not lines[end].strip():
                end -= 1
            out["code_blocks"].append({"line": k + 1, "end_line": end + 1, "language": None, "meta": None, "content": "\n".join(x[4:] if x.startswith("    ") else x.lstrip("\t") for x in lines[k : end + 1])})
            k = end + 1
            continue
        quoted = m.end() if (m := _QUOTE.match(line)) else 0
        if m := _ATX.match(line[quoted:]):
            heading(k, len(m[1]), m[2] or "", quoted + max(0, m.start(2)))
            in_paragraph = in_list = False
            k += 1
            continue
        if in_paragraph and (m := _SETEXT.match(line)):
            at, raw, column = text_lines.pop()
            paragraphs -= 1
            heading(at, 1 if m[1][0] == "=" else 2, raw.strip(), column + len(raw) - len(raw.lstrip()))
            in_paragraph = False
            k += 1
            continue
        if _BREAK.match(line):
            in_paragraph = in_list = False
            k += 1
            continue
        if m := _DEFINITION.match(line):
            definitions.setdefault(" ".join(m[1].lower().split()), (m[2], k + 1, offsets[k] + m.start(2), offsets[k] + m.end(2)))  # the first one counts
            k += 1
            continue
        if "|" in line and k + 1 < len(lines) and "-" in lines[k + 1] and _DELIMITER.match(lines[k + 1]) and len(_cells(line)) == len(_cells(lines[k + 1])):
            end = k + 1
            while end + 1 < len(lines) and lines[end + 1].strip() and "|" in lines[end + 1]:
                end += 1
            align = [{"11": "center", "10": "left", "01": "right"}.get(f"{int(c[0] == ':')}{int(c[-1] == ':')}", "none") for c in _cells(lines[k + 1])]
            out["tables"].append({"line": k + 1, "end_line": end + 1, "n_columns": len(align), "n_rows": end - k - 1, "headers": _cells(line), "align": align})
            text_lines += [(j, lines[j], 0) for j in range(k, end + 1) if j != k + 1]
            in_paragraph = in_list = False
            k = end + 1
            continue
        if m := _TASK.match(line):
            out["tasks"].append({"line": k + 1, "checked": m[1] != " ", "text": plain_text(m[2])})
            text_lines.append((k, m[2], m.start(2)))
            lists += not in_list
            in_list, in_paragraph = True, False
            k += 1
            continue
        if m := _ITEM.match(line):
            text_lines.append((k, line[m.end() :], m.end()))
            lists += not in_list
            in_list, in_paragraph = True, False
            k += 1
            continue
        if in_paragraph:  # goes on: a link may reach over the line's end
            at, raw, column = text_lines.pop()
            text_lines.append((at, f"{raw}\n{line}", column))
        else:
            text_lines.append((k, line, 0))
        if not in_list:
            paragraphs += not in_paragraph
            in_paragraph = True
        k += 1

    for at, raw, column in text_lines:
        words += len(plain_text(raw).split())
        spans = [m.span() for m in _CODE_SPAN.finditer(raw)]
        free = list(raw)
        for a, b in spans:
            free[a:b] = " " * (b - a)
        bare = "".join(free)
        place = offsets[at] + column
        found = []
        for m in _INLINE.finditer(bare):
            name = "bare" if m["angle"] is None else "angle"
            found.append((m.start(), m[1], m[2], m[name], "inline", at + 1 + bare.count("\n", 0, m.start(name)), place + m.start(name), place + m.end(name)))
        rest = list(bare)
        for m in _INLINE.finditer(bare):
            rest[m.start() : m.end()] = "\0" * (m.end() - m.start())
        for m in _REFERENCE.finditer("".join(rest)):
            name = " ".join((m[3] or m[2]).lower().split())
            if name in definitions and not re.fullmatch(r"[ xX]", m[2]):
                target, *span = definitions[name]
                found.append((m.start(), m[1], m[2], target, "shortcut" if m[3] is None else "full" if m[3] else "collapsed", *span))
        for first, bang, text, target, kind, own_line, start, end in sorted(found):
            external = bool(_EXTERNAL.match(target))
            out["links"].append({"line": at + 1 + bare.count("\n", 0, first), "text": " ".join(text.split("\n")), "target": target, "image": bool(bang), "external": external, "anchor": target.startswith("#"), "kind": kind, "destination_line": own_line, "start": start, "end": end})
    out["links"].sort(key=lambda x: x["line"])
    return out | {"words": words, "paragraphs": paragraphs, "lists": lists, "tree": _tree(out["headings"], len(lines))}


def parse_documents(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """path, content to SCHEMA, columns in keep passed through. A null content counts as empty."""
    kept = [f for f in raw.schema.fields if f.name in keep]
    ddl = SCHEMA + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in kept)
    names = _arrow().names

    def run(batches):
        schema = None
        for b in batches:
            rows = [{"path": p.as_py()} | parse(c.as_py() or "") for p, c in zip(b.column(0), b.column(1), strict=True)]
            schema = schema or _arrow()
            t = pa.RecordBatch.from_pylist(rows, schema)
            yield pa.RecordBatch.from_arrays([*t.columns, *b.columns[2:]], names=[*names, *[f.name for f in kept]])

    return raw.select("path", "content", *[F.col(f.name).alias(f"_keep{k}") for k, f in enumerate(kept)]).mapInArrow(run, ddl)


def _arrow() -> pa.Schema:
    i, s, b = pa.int32(), pa.string(), pa.bool_()
    rows = lambda *f: pa.list_(pa.struct(list(f)))
    return pa.schema(
        [
            ("path", s), ("n_lines", i), ("frontmatter_status", s), ("frontmatter", s), ("frontmatter_end", i), ("words", i), ("paragraphs", i), ("lists", i),
            ("headings", rows(("line", i), ("depth", i), ("text", s), ("slug", s))),
            ("links", rows(("line", i), ("text", s), ("target", s), ("image", b), ("external", b), ("anchor", b), ("kind", s), ("destination_line", i), ("start", i), ("end", i))),
            ("tasks", rows(("line", i), ("checked", b), ("text", s))),
            ("code_blocks", rows(("line", i), ("end_line", i), ("language", s), ("meta", s), ("content", s))),
            ("tables", rows(("line", i), ("end_line", i), ("n_columns", i), ("n_rows", i), ("headers", pa.list_(s)), ("align", pa.list_(s)))),
            ("math", rows(("line", i), ("end_line", i))),
            ("tree", rows(("line", i), ("depth", i), ("text", s), ("slug", s), ("parent", s), ("parents", pa.list_(s)), ("ordinal", i), ("last_line", i))),
        ]
    )


def rows_of(parsed: DataFrame, column: str) -> DataFrame:
    """path and the fields of one nested relation."""
    return parsed.select("path", F.explode(column).alias("r")).select("path", "r.*")


def resolved(links: DataFrame) -> DataFrame:
    """Adds resolved (workspace path of a local target, else null) and fragment.

    Targets are relative to the document, or to the workspace's root after a slash;
    ., .. and empty steps are folded, percent escapes decoded, queries dropped.
    """
    target = F.regexp_replace("target", r"[?#].*$", "")
    target = F.coalesce(F.try_url_decode(F.replace(target, F.lit("+"), F.lit("%2B"))), target)
    fragment = F.when(F.contains("target", F.lit("#")), F.regexp_extract("target", r"#(.*)$", 1))
    folder = F.regexp_replace("path", r"[^/]*$", "")
    whole = F.when(target == "", F.col("path")).when(target.startswith("/"), target).otherwise(F.concat(folder, target))
    steps = F.filter(F.split(whole, "/"), lambda s: (s != "") & (s != "."))
    fold = F.aggregate(steps, F.array().cast("array<string>"), lambda a, s: F.when((s == "..") & (F.size(a) > 0) & (F.element_at(F.concat(F.array(F.lit("")), a), -1) != ".."), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))))
    return links.withColumn("resolved", F.when(~F.col("external"), F.array_join(fold, "/"))).withColumn("fragment", fragment)


def sections(parsed: DataFrame) -> DataFrame:
    """A flat partition of each document's lines by its headings; what stands before the first has no heading."""
    head = F.filter("headings", lambda h: h["line"] > F.col("frontmatter_end"))
    starts = F.transform(head, lambda h: F.struct(h["line"].alias("start_line"), h["depth"].alias("depth"), h["text"].alias("heading"), h["slug"].alias("slug")))
    df = parsed.select("path", "n_lines", "frontmatter_end", starts.alias("s"))
    first = F.coalesce(F.get("s", F.lit(0))["start_line"], F.col("n_lines") + 1)
    pre = F.when(first > F.col("frontmatter_end") + 1, F.array(F.struct((F.col("frontmatter_end") + 1).alias("start_line"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("heading"), F.lit(None).cast("string").alias("slug")))).otherwise(F.array().cast(df.schema["s"].dataType))
    df = df.withColumn("s", F.concat(pre.cast(df.schema["s"].dataType), "s"))
    return df.select("path", "n_lines", "s", F.posexplode("s").alias("k", "x")).select("path", "x.heading", "x.slug", "x.depth", "x.start_line", (F.coalesce(F.get("s", F.col("k") + 1)["start_line"], F.col("n_lines") + 1) - 1).alias("end_line"))


def outline(parsed: DataFrame, max_depth: int = 6) -> DataFrame:
    """path, line, depth, slug, parent: the last heading before it of a smaller depth."""
    shown = F.filter("tree", lambda h: h["depth"] <= max_depth)
    return parsed.select("path", F.explode(shown).alias("x")).select("path", "x.line", "x.depth", "x.slug", "x.parent")


def outline_tree(parsed: DataFrame, max_depth: int = 6) -> DataFrame:
    """outline() with text, parents (texts from the top), ordinal among siblings and last_line."""
    shown = F.filter("tree", lambda h: h["depth"] <= max_depth)
    return parsed.select("path", F.explode(shown).alias("x")).select("path", "x.*")


def subtree_end(parsed: DataFrame) -> DataFrame:
    """path, slug, line, last_line: a section with all below it ends before the next heading of its depth or less."""
    return parsed.select("path", F.explode("tree").alias("x")).select("path", "x.slug", "x.line", "x.last_line")


def _slice(first: Column, last: Column) -> Column:
    """Lines first to last of the column content, 1-based."""
    return F.array_join(F.slice(F.split("content", "\n"), first, F.greatest(last - first + 1, F.lit(0))), "\n")


def find_section(parsed: DataFrame, heading: str, children: bool = True, include_heading: bool = True) -> DataFrame:
    """path, slug, depth, start_line, end_line, content of each document's first section of that heading.

    A heading is met by its text, whatever the case, or by the slug that the name has. Without
    children the section ends before the next heading of any depth. parsed holds content
    (``parse_documents(raw, keep=("content",))``); documents without such a heading give no row.
    """
    hit = lambda h: (F.lower(h["text"]) == heading.lower()) | (h["slug"] == slug_of(heading))
    first = F.get(F.filter("tree", hit), F.lit(0))
    rows = parsed.select("path", "content", "n_lines", "tree", first.alias("x")).where("x is not null")
    following = F.get(F.filter("tree", lambda h: h["line"] > F.col("x.line")), F.lit(0))["line"] - 1
    end = F.col("x.last_line") if children else F.coalesce(following, F.col("n_lines"))
    start = F.col("x.line") + (0 if include_heading else 1)
    return rows.select("path", "x.slug", "x.depth", start.alias("start_line"), end.alias("end_line"), _slice(start, end).alias("content"))


def section_bodies(parsed: DataFrame) -> DataFrame:
    """path, line, body of every heading below the frontmatter: what stands up to the next heading, without line ends' \\r.

    parsed holds content.
    """
    lines = F.split("content", "\n")
    heads = F.filter("headings", lambda h: h["line"] > F.col("frontmatter_end"))
    rows = parsed.select("path", "n_lines", lines.alias("l"), heads.alias("h"))
    ends = F.transform("h", lambda x, k: F.coalesce(F.get("h", k + 1)["line"] - 1, F.col("n_lines")))
    # each body is cut on the document's row, so that no heading carries the whole text
    body = F.transform(F.arrays_zip(F.col("h"), ends.alias("e")), lambda z: F.struct(z["h"]["line"].alias("line"), F.replace(F.array_join(F.slice("l", z["h"]["line"] + 1, z["e"] - z["h"]["line"]), "\n"), F.lit("\r\n"), F.lit("\n")).alias("body")))
    return rows.select("path", F.explode(body).alias("x")).select("path", "x.*")


def link_type(image: Column, external: Column, anchor: Column) -> Column:
    """image, external, anchor or internal: the first that holds."""
    return F.when(image, "image").when(external, "external").when(anchor, "anchor").otherwise("internal")


def link_listing(parsed: DataFrame, files: DataFrame, types: tuple[str, ...] = (), broken_only: bool = False) -> DataFrame:
    """path, line, text, target, type, exists, context of all links.

    files has the path of every file there is, documents and others. exists is null for
    external and anchor links. context is the link's line, trimmed; parsed holds content.
    """
    withs = parsed.select("path", "links", F.split("content", "\n").alias("l"))
    context = lambda x: F.regexp_replace(F.coalesce(F.get("l", x["line"] - 1), F.lit("")), r"^\s+|\s+$", "")
    rows = withs.select("path", F.explode(F.transform("links", lambda x: F.struct(x.alias("x"), context(x).alias("context")))).alias("r")).select("path", "r.x.*", "r.context")
    rows = rows.withColumn("type", link_type(F.col("image"), F.col("external"), F.col("anchor")))
    if types:
        rows = rows.where(F.col("type").isin(*types))
    local = ~F.col("external") & ~F.col("anchor")
    known = files.select(F.col("path").alias("resolved")).distinct().withColumn("_there", F.lit(True))
    out = resolved(rows).join(known, "resolved", "left").withColumn("exists", F.when(local, F.coalesce("_there", F.lit(False))))
    if broken_only:
        out = out.where("not exists")
    return out.select("path", "line", "text", "target", "type", "exists", "context")


def references(parsed: DataFrame, files: DataFrame, external: bool = False, anchors: bool = False, images: bool = False) -> DataFrame:
    """link_listing() of document links; external, anchor and image links only on demand."""
    off = [name for name, on in (("external", external), ("anchor", anchors), ("image", images)) if not on]
    kept = parsed.withColumn("links", F.filter("links", lambda x: ~((x["external"] & F.lit("external" in off)) | (x["anchor"] & F.lit("anchor" in off)) | (x["image"] & F.lit("image" in off)))))
    return link_listing(kept, files)


def table_at(parsed: DataFrame, index: int) -> DataFrame:
    """The table of each document at a place, counted from 1; documents with fewer give no row."""
    if index < 1:
        raise ValueError(f"tables are counted from 1, not {index}")
    return parsed.select("path", F.get("tables", F.lit(index - 1)).alias("x")).where("x is not null").select("path", "x.*")


def toc(parsed: DataFrame) -> DataFrame:
    """path, toc: nested bullet links over headings, indented from the smallest depth."""
    low = F.array_min(F.transform("headings", lambda h: h["depth"]))
    lines = F.transform("headings", lambda h: F.concat(F.expr("''"), F.repeat(F.lit("  "), h["depth"] - low), F.lit("- ["), h["text"], F.lit("](#"), h["slug"], F.lit(")")))
    return parsed.where(F.size("headings") > 0).select("path", F.array_join(lines, "\n").alias("toc"))


def structure(parsed: DataFrame) -> DataFrame:
    """path, line, kind, detail: the skeleton of a document, without its prose."""
    one = lambda column, kind, detail: parsed.select("path", F.explode(column).alias("x")).select("path", "x.line", F.lit(kind).alias("kind"), detail.cast("string").alias("detail"))
    parts = [one("headings", "heading", F.concat(F.repeat(F.lit("#"), F.col("x.depth")), F.lit(" "), F.col("x.text"))), one("code_blocks", "code", F.col("x.language")), one("tables", "table", F.concat_ws("x", "x.n_rows", "x.n_columns")), one("tasks", "task", F.col("x.text")), one("math", "math", F.lit(None))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Marks around a table of contents. Fixed values.
TOC_START, TOC_END = "<!-- toc -->", "<!-- tocstop -->"


def toc_state(documents: DataFrame, tocs: DataFrame) -> DataFrame:
    """path, state of documents (path, content): missing, malformed (one mark, or more than one pair), synchronised or stale against tocs."""
    count = lambda mark: F.size(F.split("content", mark)) - 1
    held = F.trim(F.substring_index(F.substring_index("content", TOC_START, -1), TOC_END, 1), F.lit("\n "))
    state = F.when((count(TOC_START) == 0) & (count(TOC_END) == 0), "missing").when((count(TOC_START) != 1) | (count(TOC_END) != 1) | (F.instr("content", TOC_START) > F.instr("content", TOC_END)), "malformed")
    return documents.join(tocs, "path", "left").select("path", state.when(held == F.coalesce("toc", F.lit("")), "synchronised").otherwise("stale").alias("state"))
