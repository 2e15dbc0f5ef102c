"""Plain versions of the operators' results, one text at a time."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PROSE = " ".join(f"The reader{i} went{i} to writer{i * 7} because news{i * 3} had come{i}." for i in range(40))
CASES = [
    (1, "Hello world, this is a first line.\nAnd a second one! Written by a@b.co at 10.0.0.1."),
    (2, None),
    (3, ""),
    (4, "   \n\t \x0b\x0c\r "),
    (5, "one two three one two three one two three " * 20),
    (5, "one two three one two three one two three " * 20),
    (6, "Accented Ünïcode wörds 日本語 and \U0001f600 emoji in a sentence that goes on and on until it has enough words to count as a text. " * 6),
    (7, " | ".join(f"menu{i}" for i in range(80))),
    (8, PROSE + "\nAll rights reserved."),
    (9, "word " * 60_000 + "end."),
    (10, "x" * 200_000),
    (None, "A row without an id but with a text of its own, said once only."),
    (11, PROSE + "\nAll rights reserved!"),
    (12, "don't Stop's <|endoftext|> é 4111 1111 1111 1111 +1 (212) 555-0199 | pipes |"),
]


def rows(spark, cases=CASES):
    """Documents with columns whose names the operators use inside."""
    extra = ["_text", "_key", "k0", "fp", "size", "piece", "language", "spans", "n_words", "group", "row", "accepted", "kept"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    return spark.createDataFrame([(d, t, "en", None if i % 5 == 4 else f"src{i % 3}", None if t is None else len(t), *extra) for i, (d, t) in enumerate(cases)], schema).repartition(3)


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []


def fingerprint(text, k=3):
    s = Counter(shingles(text, k))
    n, ones = sum(s.values()), [0] * 64
    for x, c in s.items():
        h = xxhash.xxh64_intdigest(x.encode(), 42)
        for b in range(64):
            ones[b] += c * (h >> b & 1)
    return sum((2 * o > n) << b for b, o in enumerate(ones)) if n else 0


def alike_groups(cases, share=(4, 5)):
    """Least id of each id's group, by all pairs."""
    sets = {d: set(shingles(t, 5)) for d, t in cases}
    group = {d: d for d in sets}
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if (share[1] * both >= share[0] * (len(sets[a]) + len(sets[b]) - both)) and group[a] != group[b]:
            low, high = sorted((group[a], group[b]))
            group = {d: low if g == high else g for d, g in group.items()}
    return group


def quality(text):
    t = text or ""
    w = WORD.findall(t)
    at = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if at[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def contamination(text, items, span=10):
    d = ALNUM.findall((text or "").translate(LOWER))
    hit, names = set(), set()
    for name, body in items:
        w = ALNUM.findall((body or "").translate(LOWER))
        m = min(span, len(w))
        wins = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
        for i in range(len(d) - m + 1):
            if m and tuple(d[i : i + m]) in wins:
                hit.update(range(i, i + m))
                names.add("null" if name is None else str(name))
    return len(d), len(hit), sorted(names)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def components(prints, errors=3):
    """Least key of each print's component."""
    n = len(prints)
    group = list(range(n))
    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= errors and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return group


def trigrams(text):
    """Buckets of the byte trigrams of a text's letters, words held apart by single spaces; trigrams around a space's own middle, or with
    two spaces in a row at an end, say nothing."""
    data = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in (text or "").encode())
    out = []
    for a, b, c in zip(data, data[1:], data[2:]):
        if b != 32 or (a != 32 and c != 32):
            out.append((((a << 16 | b << 8 | c) * 0x9E3779B1) % 2**32) >> 17)
    return out


def language(cases, model, langid):
    """key: (language, text language, accepted, posterior) for (key, text, declared, host)."""
    names = (*model.languages, "und")
    last = len(names) - 1
    world = [(1 - langid.UNKNOWN_PRIOR) / last] * last + [langid.UNKNOWN_PRIOR]
    rows, votes = [], []
    for key, text, declared, host in cases:
        grams = trigrams(text)
        score = [langid.TEMPER * math.fsum(float(model.log_p[g, k]) for g in grams) for k in range(len(names))]
        first = (declared or "").strip(" ").lower().replace("_", "-").split("-")[0]
        claim = names.index(first) if first in names[:-1] else last
        host = (host or "").lower()
        suffix = host.rpartition(".")[2] if "." in host else ""
        alone = max(range(len(names)), key=lambda k: score[k] + math.log(world[k])) if grams else last
        rows.append((key, grams, score, claim, host, suffix, alone))
        votes.append((host, suffix, claim, alone))

    def prior(kept, above):
        n = [sum(1 for v in votes if kept(v) and v[3] == k) for k in range(len(names))]
        return [(x + langid.SMOOTHING * a) / (sum(n) + langid.SMOOTHING) for x, a in zip(n, above)]

    base = prior(lambda v: True, [1 / len(names)] * len(names))
    out = {}
    for key, grams, score, claim, host, suffix, alone in rows:
        near = prior(lambda v: v[0] == host, prior(lambda v: v[1] == suffix, base))
        total = []
        for k in range(len(names)):
            own = [v for v in votes if v[3] == k]
            assumed = langid.HONEST if claim == k else (1 - langid.HONEST) / (len(names) - 1)
            told = (sum(v[2] == claim for v in own) + langid.SMOOTHING * assumed) / (len(own) + langid.SMOOTHING)
            total.append(score[k] + math.log(told) + math.log(near[k]))
        share = [math.exp(t - max(total)) for t in total]
        best = share.index(max(share)) if grams else last
        sure = max(share) / sum(share) if grams else 1.0
        out[key] = (names[best], names[alone], best < last and sure >= 0.5, sure)
    return out


SPACED = {"p", "ul", "table"}


def rendered(tree, visible=True):
    """Lines of a tree (tag, attributes, children or text): what a browser's text shows, for a few well-formed elements. Events come first
    (text, end of line, empty line), lines are then made of them."""
    events = []

    def walk(node, visible, depth):
        if isinstance(node, str):
            if visible:
                events.append(("text", node))
            return
        tag, style, children = node
        if style == "display:none":
            return
        visible = {"visibility:hidden": False, "visibility:visible": True}.get(style, visible)
        if tag == "br":
            events.append(("break",))
            return
        block = tag in ("div", "p", "ul", "li", "table")
        edge = ("gap",) if tag in SPACED and not (tag == "ul" and depth) else ("end",)
        if block:
            events.append(edge)
        if tag == "li":
            events.append(("item", depth))
        if tag == "table":
            events.append(("rows", [[rendered(("cell", "", cell), visible) for cell in row] for row in children]))
        else:
            for c in children:
                walk(c, visible, depth + (tag == "ul"))
        if tag == "li":
            events.append(("done",))
        if block:
            events.append(edge)

    walk(tree, visible, 0)
    lines, words, gap, indent, marker, spaces = [], "", False, [], "", False

    def flush():
        nonlocal words, gap, marker
        text = re.sub("[ \\t\\n]+", " ", words).strip(" ")
        words = ""
        if text:
            if gap and lines:
                lines.append("")
            gap = False
            lines.append("".join(indent[:-1]) + "- " + text if marker else "".join(indent) + text)
            marker = ""

    for kind, *more in events:
        if kind == "text":
            words += more[0]
        elif kind == "break":
            if words.strip():
                flush()
            elif lines and not gap:
                lines.append("")
            words = ""
        elif kind == "rows":
            flush()
            wide = [max((len(x) for row in more[0] for x in (row[c] if c < len(row) else ())), default=0) for c in range(max(map(len, more[0]), default=0))]
            for row in more[0]:
                for i in range(max(map(len, row), default=0)):
                    if gap and lines:
                        lines.append("")
                    gap = False
                    line = "".join((cell[i] if i < len(cell) else "").ljust(wide[c] + 2) for c, cell in enumerate(row)).rstrip(" ")
                    lines.append(("".join(indent[:-1]) + "- " + line if marker else "".join(indent) + line).rstrip())
                    marker = ""
            gap = bool(lines)
        else:
            flush()
            gap = gap or (kind == "gap" and bool(lines))
            if kind == "item":
                indent.append("  ")
                marker = "- "
            elif kind == "done":
                marker = ""
                indent.pop()
    flush()
    while lines and not lines[-1]:
        lines.pop()
    return lines


def markup(node):
    if isinstance(node, str):
        return node
    tag, style, children = node
    own = f' style="{style}"' if style else ""
    if tag == "br":
        return "<br>"
    if tag == "table":
        inner = "".join("<tr>" + "".join("<td>" + "".join(map(markup, cell)) + "</td>" for cell in row) + "</tr>" for row in children)
    else:
        inner = "".join(map(markup, children))
    return f"<{tag}{own}>{inner}</{tag}>"
