"""Document trees against a recursion over the parsed JSON, of depths from 1 to 12."""

from __future__ import annotations

import json
import random

import pytest

from scholarframe.operators import trees


def escaped(text):
    text = text.replace("\\", "\\textbackslash{}")
    return "".join(f"\\{c}" if c in "&%$#_{}" else c for c in text).replace("~", "\\textasciitilde{}").replace("^", "\\textasciicircum{}")


def inline(node, labels, latex):
    if node.get("type") == "citation":
        return labels.get(node.get("attrs", {}).get("workKey"), "\\textbf{[missing citation]}" if latex else "[missing citation]")
    if "text" in node:
        out, marks = escaped(node["text"]) if latex else node["text"], {m["type"] for m in node.get("marks", [])}
        if "italic" in marks:
            out = f"\\emph{{{out}}}" if latex else f"*{out}*"
        if "bold" in marks:
            out = f"\\textbf{{{out}}}" if latex else f"**{out}**"
        return out
    return "".join(inline(c, labels, latex) for c in node.get("content", []))


def block(node, labels, latex):
    kind, inner = node.get("type"), "".join(inline(c, labels, latex) for c in node.get("content", []))
    if kind == "heading":
        level = node.get("attrs", {}).get("level", 1)
        return f"\\{('section', 'subsection', 'subsubsection')[min(max(level, 1), 3) - 1]}{{{inner}}}" if latex else f"{'#' * min(6, max(1, level))} {inner}"
    if kind == "blockquote":
        return f"\\begin{{quote}}\n{inner}\n\\end{{quote}}" if latex else "\n".join(f"> {x}" for x in inner.split("\n"))
    if kind in ("bulletList", "orderedList"):
        rows = [" ".join(block(c, labels, latex) for c in item.get("content", [])) for item in node.get("content", [])]
        if latex:
            env = "itemize" if kind == "bulletList" else "enumerate"
            return f"\\begin{{{env}}}\n" + "\n".join(f"  \\item {r}" for r in rows) + f"\n\\end{{{env}}}"
        return "\n".join(f"- {r}" if kind == "bulletList" else f"{i + 1}. {r}" for i, r in enumerate(rows))
    return inner


def made(rng, depth):
    if depth <= 1 or rng.random() < 0.25:
        if rng.random() < 0.3:
            return {"type": "citation", "attrs": {"workKey": f"w{rng.randint(0, 6)}"}}
        return {"type": "text", "text": rng.choice(["50% & a_b", "~x^\\{}", "é 日本", "two\nlines", "", "plain "]), "marks": [{"type": m} for m in ("bold", "italic", "other") if rng.random() < 0.3]}
    kind = rng.choice(["paragraph", "heading", "blockquote", "bulletList", "orderedList", "listItem"])
    node = {"type": kind, "content": [made(rng, depth - 1) for _ in range(rng.randint(0, 3))]}
    if kind.endswith("List"):
        node["content"] = [{"type": "listItem", "content": [made(rng, depth - 2) for _ in range(rng.randint(0, 3))]} for _ in range(rng.randint(0, 3))]
    if kind == "heading" and rng.random() < 0.8:
        node["attrs"] = {"level": rng.randint(0, 8)}
    return node


def keys(node, out):
    if node.get("type") == "citation":
        key = node["attrs"]["workKey"]
        out += [] if key in out else [key]
        return out
    for child in [] if "text" in node else node.get("content", []):
        keys(child, out)
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    out = [(i, f"T_{i}", {"type": "doc", "content": [made(rng, 1 + i % 12) for _ in range(rng.randint(0, 6))]}) for i in range(36)]
    deep = {"type": "text", "text": "deep"}
    for k in range(4):
        deep = {"type": "bulletList" if k % 2 else "orderedList", "content": [{"type": "listItem", "content": [deep]}]}
    return [*out, (99, "T_99", {"type": "doc", "content": [deep, {"type": "p"}]})]


def test_four_formats(spark, docs):
    odd = [(200, "Null", None), (201, "No JSON", "{"), (202, "List", "[1]"), (203, "Bare", "{}"), (204, "Odd", '{"content":[null,3,"x",{"type":5,"text":7},{"type":"p","content":{"a":1}}]}')]
    df = spark.createDataFrame([(k, t, json.dumps(tree)) for k, t, tree in docs] + odd, "id long, title string, tree string").repartition(3)
    works = spark.createDataFrame([(f"w{k}", f"(W{k})", f"Work {k}.", f"b{k}", f"@b{k}", f"TY{k}") for k in range(5)], "work_key string, label string, entry string, bib_key string, bibtex string, ris string")
    got = {(r.key, r.format): r for r in trees.export(df, "id", "title", "tree", works).collect()}
    assert len(got) == 4 * (len(docs) + len(odd))
    for key, title, tree in docs:
        order = keys(tree, [])
        for latex in (False, True):
            labels = {f"w{k}": f"\\cite{{b{k}}}" if latex else f"(W{k})" for k in range(5)}
            blocks = [block(c, labels, latex) for c in tree["content"] if c.get("type") != "citation" and "text" not in c]
            blocks = [b if isinstance(b, str) else "" for b in (block(c, labels, latex) for c in tree["content"])]
            body = "\n\n".join(b for b in blocks if b.strip())
            if latex:
                stem = title
                assert got[key, "latex"].content == "\\documentclass{article}\n\\usepackage[utf8]{inputenc}\n\\title{" + escaped(title) + "}\n\\begin{document}\n\\maketitle\n\n" + body + "\n\n\\bibliographystyle{plain}\n\\bibliography{" + stem + "}\n\\end{document}", (key, tree)
            else:
                lines = "\n".join(f"- Work {k[1:]}." if int(k[1:]) < 5 else f"- [missing citation] ({k})" for k in order)
                assert got[key, "markdown"].content == f"# {title}\n\n{body}\n\n## References\n\n{lines}", (key, tree)
        known = [k[1:] for k in order if int(k[1:]) < 5]
        assert got[key, "bibtex"].content == got[key, "latex"].bib == "\n\n".join(f"@b{k}" for k in known)
        assert got[key, "ris"].content == "\n\n".join(f"TY{k}" for k in known) and got[key, "ris"].filename == f"{title}.ris"
    for key, title, _ in odd:
        assert got[key, "markdown"].content == f"# {title}\n\n\n\n## References\n\n"
