"""Plain Python versions of the operators, to compare with; slow and simple on purpose."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import os
import re

import xxhash

from wrenchlight.llm import decontaminate, fertility


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def group(nodes, pairs):
    """Smallest node of each node's component."""
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def without_windows(texts, size=35):
    """(n_words, n_removed, digest of the rest) of each text."""
    every = [words(t) for t in texts]
    count = collections.Counter(tuple(w[i : i + size]) for w in every for i in range(len(w) - size + 1))
    out = []
    for w in every:
        gone = set()
        for i in range(len(w) - size + 1):
            if count[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def fingerprint(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_groups(prints, bits=2):
    """Smallest key of each key's component, for {key: fingerprint}."""
    keys = sorted(prints)
    return group(keys, [(a, b) for i, a in enumerate(keys) for b in keys[:i] if bin(prints[a] ^ prints[b]).count("1") <= bits])


def lines_left(docs, min_words=5):
    """{key: text} without the lines of later copies; all runs of all lengths are compared. docs: {key: text} in order."""
    cut = {k: (t or "").split("\n") for k, t in docs.items()}
    counted = {k: [i for i, x in enumerate(v) if words(x)] for k, v in cut.items()}
    first, gone = {}, {k: set() for k in docs}
    for k in docs:
        at = counted[k]
        for a in range(len(at)):
            for b in range(a + 1, len(at) + 1):
                first.setdefault(tuple(cut[k][i] for i in at[a:b]), (k, a))
    for k in docs:
        at = counted[k]
        for a in range(len(at)):
            for b in range(a + 1, len(at) + 1):
                run = tuple(cut[k][i] for i in at[a:b])
                if first[run] != (k, a) and sum(len(words(x)) for x in run) >= min_words:
                    gone[k].update(at[a:b])
    return {k: docs[k] if docs[k] is None else "\n".join(x for i, x in enumerate(v) if i not in gone[k]) for k, v in cut.items()}


def base_counts(text):
    text = text or ""
    w = words(text)
    count = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeat = {i + j for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat)


class Measures:
    def __init__(self):
        import sentencepiece
        import tiktoken

        folder = fertility.VOCABULARIES
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, fertility.PIECES))
        with open(os.path.join(folder, fertility.BYTE_LEVEL), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes = tiktoken.Encoding("plain", pat_str=fertility.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def of(self, text):
        """n_tokens and the four measures."""
        parts = [w[i : i + 256] for w in words(text) for i in range(0, len(w), 256)]
        tokens = [t for p in parts for t in self.pieces.encode(p)]
        n, chars = len(tokens), sum(map(len, parts))
        level = sum(len(self.bytes.encode_ordinary(" " + p)) for p in parts)
        share = sum(map(self.pieces.is_byte, tokens)) / max(n, 1)
        entropy = -sum(c / n * math.log2(c / n) for c in collections.Counter(tokens).values()) / math.log2(n) if n > 1 else 0.0
        return n, (chars / max(n, 1), share, entropy, chars / max(level, 1))


def kept_by_quality(rows, measures, rules=fertility.Rules()):
    """Keys that pass, for (key, text, lang) with a lang that is not NULL."""
    judged = {k: (base_counts(t), measures.of(t), lang) for k, t, lang in rows}
    good = {k: v for k, v in judged.items() if v[0][0] >= rules.min_words and 100 * v[0][4] <= rules.max_repeat_percent * v[0][0]}
    bands = {}
    for lang in {v[2] for v in good.values()}:
        for m in range(4):
            x = sorted(v[1][1][m] for v in good.values() if v[2] == lang)
            bands[lang, m] = [x[max(0, math.ceil(q * len(x)) - 1)] for q in (0.25, 0.5, 0.75)]
    kept = set()
    for k, (_, (n, values), lang) in good.items():
        for m in range(4):
            low, mid, high = bands[lang, m]
            spread = math.sqrt(max((high - low) / 1.349, rules.floor[m]) ** 2 + rules.noise[m] / max(n, 1))
            if abs(values[m] - mid) > rules.width * spread:
                break
        else:
            kept.add(k)
    return kept


def template(text, reading):
    """(kind, word or value) of each template word; reading 0: names within sentences, 1: all capitals, 2: none."""
    out, before = [], None
    for m in re.finditer(r"(?:(?![ -‿])[0-9A-Za-z\u0080-\U0010ffff])+", text or ""):
        gap = text[before.end() : m.start()] if before else ""
        last = out[-1] if out else None
        if re.search("[0-9]", m[0]):
            kind = "number"
        elif last and last[0] == "number" and m[0].lower() in decontaminate.UNITS:
            kind = "unit"
        elif reading < 2 and m[0][0].isupper() and ord(m[0][0]) < 0x800 and (reading == 1 or (before and not re.search(r"[.!?\n]", gap))):
            kind = "name"
        else:
            kind = "word"
        inner = before and not re.search(r"[.!?\n]", gap)
        if last and last[0] == kind == "number" and re.fullmatch("[.,:/-]", gap) or last and last[0] == kind == "name" and inner and was_inner:
            out[-1] = (kind, last[1] + gap + m[0])
        else:
            out.append((kind, m[0]))
        before, was_inner = m, inner
    small = lambda c: c.lower() if ord(c) < 0x800 and len(c.lower()) == 1 and (c.isascii() or 0x80 <= ord(c.lower()) < 0x800) else c
    return [(k, "".join(map(small, v))) for k, v in out]


def leaks(docs, items, size=5, share=0.8, run=25, literals=3):
    """Pairs (doc, item) for {key: text} of both."""

    def windows(text, reading):
        t = template(text, reading)
        found = []
        for i in range(len(t) - size + 1):
            part = t[i : i + size]
            if sum(k == "word" for k, _ in part) >= literals:
                found.append((i, tuple((k, v if k == "word" else None) for k, v in part), [v if k != "word" else None for k, v in part]))
        return found

    out = set()
    for reading in range(3):
        known = {k: windows(t, reading) for k, t in items.items()}
        at = collections.defaultdict(list)
        for k, found in known.items():
            for i, key, values in found:
                at[key].append((k, i, values))
        for d, text in docs.items():
            hits = collections.defaultdict(lambda: collections.defaultdict(lambda: (set(), set())))
            for i, key, values in windows(text, reading):
                for k, j, theirs in at.get(key, ()):
                    places, pairs = hits[k][i - j]
                    places.add(j)
                    pairs.update((a, b) for a, b in zip(theirs, values) if a is not None)
            for k, shifts in hits.items():
                groups = [[s] for s in shifts]
                chain = []
                for s in sorted(shifts):
                    if chain and s - chain[-1] > 5:
                        groups.append(chain)
                        chain = []
                    chain = [*chain, s]
                groups.append(chain)
                for group in groups:
                    places, pairs = set().union(*(shifts[s][0] for s in group)), set().union(*(shifts[s][1] for s in group))
                    even = len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})
                    if even and (len(places) >= share * len(known[k]) or len(places) + size - 1 >= run):
                        out.add((d, k))
    return out


def mix(rows):
    """{doc_id: (size, source_size, target, taken)} for (doc_id, text, source)."""
    size = {d: len(words(t)) for d, t, _ in rows}
    total = collections.Counter()
    for d, _, s in rows:
        total[s] += size[d]
    order = sorted((s for s in total if s is not None)) + [s for s in total if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in full)
        open_weight = sum(weight[s] for s in order if s not in full)
        target = {s: 3.0 * total[s] if s in full else left * weight[s] / open_weight for s in order}
        more = {s for s in order if target[s] > 3 * total[s]}
        if not more:
            break
        full |= more
    digest = {d: hashlib.md5(f"{'' if d is None else d}|{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest() for d, t, _ in rows}
    out, place = {}, collections.Counter()
    for d, _, s in sorted(rows, key=lambda r: digest[r[0]]):
        copies = sum(p * total[s] + place[s] + size[d] / 2 < target[s] for p in range(3)) if size[d] else 0
        place[s] += size[d]
        out[d] = (size[d], total[s], target[s], copies * size[d])
    return out


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = {}
    for kind, pattern in PII.items():
        out[kind] = []
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            bad = (
                kind == "ip" and any(int(p) > 255 for p in m[0].split("."))
                or kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits))
                or kind == "phone" and not 8 <= len(digits) <= 15
            )
            if not bad:
                out[kind].append(m.span())
    return out


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k in PII for a, b in sorted(spans[k]))




def mail_threads(messages):
    """{turn: (parent, thread, depth, {(level, original)})} of one conversation, {turn: text}, by comparing passages as texts."""

    def normal(text):
        return " ".join(re.findall(r"[^\W_]+", text.lower()))

    def cut(text):
        """{level: passages, paragraphs and lines, normalised}; level 0 without introductions."""
        runs = []
        for line in text.split("\n"):
            level, rest = 0, line.lstrip(" \t")
            while rest.startswith(">"):
                level, rest = level + 1, rest[1:].lstrip(" \t") if rest[1:2] in (" ", "\t") else rest[1:]
            if runs and runs[-1][0] == level:
                runs[-1][1].append(rest if level else line)
            else:
                runs.append((level, [rest if level else line]))
        own, found = [], collections.defaultdict(set)
        for i, (level, lines) in enumerate(runs):
            lines = list(lines)
            if level == 0 and i + 1 < len(runs):
                while lines and not lines[-1].strip():
                    lines.pop()
                if lines and re.search(r"(wrote|writes|said)\s*:\s*$", lines[-1]):
                    lines.pop()
            if level == 0:
                own += lines
            else:
                for unit in [" ".join(lines), *lines, *(" ".join(p.split("\n")) for p in re.split(r"\n\s*\n", "\n".join(lines)))]:
                    found[level].add(normal(unit))
        text = "\n".join(own).strip()
        found[0] = {normal(u) for u in [text.replace("\n", " "), *text.split("\n"), *(p.replace("\n", " ") for p in re.split(r"\n\s*\n", text))]}
        return {k: v - {""} for k, v in found.items()}

    parts = {t: cut(text) for t, text in messages.items()}
    first = {}
    for t in sorted(parts):
        for unit in parts[t][0]:
            first.setdefault(unit, t)
    out = {}
    for t in sorted(parts):
        found = collections.defaultdict(list)
        for level, units in parts[t].items():
            for unit in units if level else ():
                if first.get(unit, t) < t:
                    found[level, first[unit]].append(len(unit.split()))
        if found:
            nearest = min(level for level, _ in found)
            parent = max((max(n), len(n), o) for (level, o), n in found.items() if level == nearest)[2]
            out[t] = (parent, out[parent][1], out[parent][2] + 1, set(found))
        else:
            out[t] = (None, t, 0, set())
    return out
