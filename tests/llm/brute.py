"""Plain versions of the corpus queries' contracts, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def op1(docs, tokenizer, end_id=1):
    out, start = [], 0
    for doc_id, text in sorted(docs, key=lambda x: (x[0] is not None, x[0], spark_hash(x[1]), x[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def op2(docs, items, n=10):
    windows = defaultdict(set)
    for item, text in items:
        w = ITEM_WORD.findall((text or "").translate(ASCII_LOWER))
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[i : i + n])].add(str(item))
    out, sizes = [], {len(w) for w in windows}
    for doc_id, text in docs:
        w = ITEM_WORD.findall((text or "").translate(ASCII_LOWER))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (t := tuple(w[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[t]
        out.append((doc_id, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def op3(docs, n=13):
    first = {}
    split = [(doc_id, WORD.findall(text or "")) for doc_id, text in docs]
    for doc_id, w in split:
        for i in range(len(w) - n + 1):
            t = tuple(w[i : i + n])
            first[t] = min(first.get(t, doc_id), doc_id)
    out = []
    for doc_id, w in split:
        gone = {j for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] < doc_id for j in range(i, i + n)}
        out.append((doc_id, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def op4(docs):
    rules = [("assign", r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32)]
    out = []
    for doc_id, text in docs:
        spans = [(m.start(), i, m.end()) for i, (_, p, g, least) in enumerate(rules) for m in re.finditer(p, text or "") if len(m[g]) >= least]
        n = Counter(i for _, i, _ in spans)
        out.append((doc_id, n[0], n[1], n[2], sha(",".join(f"{rules[i][0]}:{a}:{b}" for a, i, b in sorted(spans)))))
    return out


def op5(docs):
    out = []
    for doc_id, text in docs:
        text = text or ""
        w, seen, dup = WORD.findall(text), set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        rep = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        out.append((doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w)))
    return out


def fp6(text, k=4):
    w = WORD.findall((text or "").translate(ASCII_LOWER))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def op6(docs, k=4, radius=4):
    fps = [(doc_id, fp6(text, k)) for doc_id, text in docs]
    names = sorted({f for _, f in fps})
    up = {f: f for f in names}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    arr = np.array(names, np.uint64)
    for i, a in enumerate(names):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ np.uint64(a)) <= radius):
            up[root(names[i + 1 + j])] = root(a)
    low = {}
    for d, f in fps:
        low[root(f)] = min(low.get(root(f), d), d)
    return [(d, f"{f:016x}", low[root(f)]) for d, f in fps]


def op10(docs, n=400):
    raw = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[i : i + n] for _, b in raw for i in range(len(b) - n + 1))
    out = []
    for d, b in raw:
        gone = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i] += 1
                gone[i + n] -= 1
        mask = np.cumsum(gone)[: len(b)] > 0
        runs = int(np.count_nonzero(np.diff(np.r_[0, mask.astype(int)]) == 1))
        out.append((d, len(b), int(mask.sum()), runs, sha(bytes(np.frombuffer(b, np.uint8)[~mask]))))
    return out


def op8_rows(docs):
    """(doc_id, n_tokens, score) of every row, also where doc_ids repeat."""
    return op8(docs, as_rows=True)


def op8(docs, depth=6, as_rows=False):
    """Base and context-tree scores, node by node."""
    import math

    out_of = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    tokens = lambda t: [*WORD.findall((t or "").translate(ASCII_LOWER)), None]
    counts = Counter(w for d, t in docs if not out_of(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    seen, below = defaultdict(lambda: [0, 0]), defaultdict(set)

    def decisions(text):
        b = bytes(depth) + (text or "").encode()
        for i in range(depth, len(b)):
            for k in range(8):
                yield b, i, 1 << k | b[i] >> (8 - k), b[i] >> (7 - k) & 1

    for d, t in docs:
        for b, i, q, bit in decisions(t) if not out_of(d) else ():
            for e in range(depth + 1):
                seen[b[i - e : i], q][bit] += 1
                if e:
                    below[b[i - e + 1 : i], q].add((b[i - e : i], q))
    kt = lambda z: math.lgamma(z[0] + 0.5) + math.lgamma(z[1] + 0.5) - math.lgamma(sum(z) + 1) - math.log(math.pi)
    weight = {}
    for key in sorted(seen, key=lambda k: -len(k[0])):
        a = kt(seen[key])
        weight[key] = a if len(key[0]) == depth else float(np.logaddexp(a, sum(weight[x] for x in below[key]))) - math.log(2)

    def score(text):
        total = 0.0
        for b, i, q, bit in decisions(text):
            p = None
            for e in range(depth, -1, -1):
                key = b[i - e : i], q
                z = seen.get(key, [0, 0])
                own = (z[bit] + 0.5) / (sum(z) + 1)
                stop = math.exp(kt(z) - math.log(2) - weight[key]) if key in weight else 0.5
                p = own if p is None else stop * own + (1 - stop) * p
            total += math.log10(p)
        return total

    if as_rows:
        return [(d, len(tokens(t)), score(t)) for d, t in docs]
    return {d: (out_of(d), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), score(t)) for d, t in docs}


def spark_hash(*values):
    """Spark's xxhash64 of strings, longs (int) and 32-bit integers (given as bytes), as a signed number; null is passed by."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v if isinstance(v, bytes) else v.to_bytes(8, "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def op9(docs, max_repeats, block_tokens, key="quillmesh"):
    """(src, doc_id, n_tokens, epoch, block, rank) of every draw; docs: (doc_id, text, source)."""
    import math

    rows = [("n" if s is None else f"s{s}", d, len(WORD.findall(t or "")) + 1, spark_hash(t)) for d, t, s in docs]
    sizes = Counter()
    for src, _, n, _ in rows:
        sizes[src] += n
    most, least = max(sizes.values()), min(sizes.values())
    a = max(0.0, 1 - math.log(max_repeats) / math.log(most / least)) if most > least else 0.0
    blocks = defaultdict(list)
    for src, d, n, tie in rows:
        blocks[src, spark_hash(key, src, d, tie) % max(1, math.ceil(sizes[src] / block_tokens))].append((d, n, tie))
    out = []
    for (src, block), held in blocks.items():
        epochs = (most / sizes[src]) ** (1 - a) + 1e-9
        whole = math.floor(epochs)
        held.sort(key=lambda x: (spark_hash(key, whole.to_bytes(4, "little"), x[0], x[2]), x[0] is not None, x[0] or 0, x[2]))
        budget, before = sum(n for _, n, _ in held) * (epochs - whole), 0
        for d, n, tie in held:
            times = whole + (before + n / 2 <= budget)
            before += n
            out += [(src, d, n, e, block, spark_hash(key, e.to_bytes(4, "little"), d, tie)) for e in range(times)]
    return out


DIGIT, LOWER, UPPER = ("0", 10), ("a", 26), ("A", 26)


class Finder:
    """Personal data in a text, place by place, without the operator's patterns: each kind is tried by hand at every character."""

    LENGTHS = (16, 15, 19, 14, 13, 18, 17)
    SHAPES = ([4, 4, 4, 4], [4, 6, 5], [4, 6, 4], [4, 4, 4, 4, 3])
    LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
    HOST = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")

    def __init__(self, text):
        self.t = text

    def at(self, i):
        return self.t[i] if 0 <= i < len(self.t) else ""

    def digits(self, i):
        """End of the digits from i on."""
        while self.at(i) and self.at(i) in "0123456789":
            i += 1
        return i

    def is_digit(self, i):
        return self.at(i) != "" and self.at(i) in "0123456789"

    def form(self, i, form):
        """End of a text like form, in which 9 stands for a digit; 0 if it is not there."""
        here = self.t[i : i + len(form)]
        fits = len(here) == len(form) and all((c in "0123456789") if f == "9" else c == f for c, f in zip(here, form, strict=True))
        return i + len(form) if fits else 0

    def email(self, i):
        if i and self.at(i - 1) in self.LOCAL:
            return 0
        j = i
        while self.at(j) and self.at(j) in self.LOCAL:
            j += 1
        if j == i or self.at(j) != "@":
            return 0
        labels, end = 0, 0
        j += 1
        while True:
            k = j
            while self.at(k) and self.at(k) in self.HOST:
                k += 1
            if k == j:
                break
            labels, end = labels + 1, k
            if self.at(k) != ".":
                break
            j = k + 1
        return end if labels > 1 else 0

    def date(self, i):
        if i and (self.is_digit(i - 1) or self.at(i - 1) == "."):
            return 0
        for form in ("9999-99-99", "99.99.9999", "99/99/9999"):
            if end := self.form(i, form):
                j = end
                while self.at(j) and self.at(j) in "0123456789.":
                    if self.is_digit(j):
                        return 0
                    j += 1
                return end
        return 0

    def ssn(self, i):
        end = self.form(i, "999-99-9999")
        return end if end and not (i and (self.is_digit(i - 1) or self.at(i - 1) == "-")) and not self.is_digit(end) and self.at(end) != "-" else 0

    def ip(self, i):
        if i and (self.is_digit(i - 1) or self.at(i - 1) == "."):
            return 0
        j = i
        for part in range(4):
            k = self.digits(j)
            if not 1 <= k - j <= 3 or part < 3 and self.at(k) != ".":
                return 0
            j = k + 1
        return 0 if self.is_digit(k) or self.at(k) == "." and self.is_digit(k + 1) else k

    def phone(self, i):
        # Telephone numbers are told by their formats, so these are stated as such.
        forms = (
            r"\+1[ .-]?(\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)", r"\+\d{1,3}[ .-]?\d{1,3}(?=([ .-]\d\d)+)(?:(?:[ .-]\d\d){4}|(?:[ .-]\d\d){3}(?![ .-]\d\d))(?![ .-]?\d)",
            r"\+\d{1,3}[ .-]?(\(\d{1,4}\)|\d{1,4})[ .-]?\d{2,4}[ .-]?\d{2,4}([.-]?\d{2,4})?(?!\d)", r"\(\d{3}\) ?\d{3}-\d{4}(?!\d)", r"(?<![\d.-])\d{3}-\d{3}-\d{4}(?![\d-])",
        )
        return next((m.end() for f in forms if (m := re.compile(f, re.A).match(self.t, i))), 0)

    def other(self, i):
        return next(((k, end) for k, find in (("email", self.email), ("phone", self.phone), ("date", self.date), ("ssn", self.ssn), ("ip", self.ip)) if (end := find(i))), None)

    def run(self, i):
        """(start, end) of the groups of a run of numbers; a separator is a space, dash or dot, or two spaces."""
        if not self.is_digit(i) or i and self.is_digit(i - 1):
            return []
        groups, j = [], i
        while self.is_digit(j) and not self.other(j):
            groups.append((j, self.digits(j)))
            j = groups[-1][1]
            gap = 2 if self.t[j : j + 2] == "  " else 1
            if self.at(j) not in (" ", ".", "-") or not self.is_digit(j + gap):
                break
            j += gap
        return groups

    def cards(self, groups):
        """Spans of the groups: usual shapes first, then from the left; of one start the first of LENGTHS."""

        def kind(i, j):
            held, gaps = groups[i:j], {self.t[a[1] : b[0]] for a, b in zip(groups[i:j], groups[i + 1 : j], strict=False)}
            sizes = [b - a for a, b in held]
            number = "".join(self.t[a:b] for a, b in held)
            if len(number) not in self.LENGTHS or sum(sum(divmod(int(c) * (1 + x % 2), 10)) for x, c in enumerate(reversed(number))) % 10:
                return None
            usual = len(sizes) == 1 or sizes in self.SHAPES and len(gaps) == 1
            return (not usual, self.LENGTHS.index(len(number))) if usual or gaps <= {" ", "-"} else None

        best = [min(((k, j) for j in range(i + 1, min(len(groups), i + 19) + 1) if (k := kind(i, j))), default=None) for i in range(len(groups))]
        out, i = [], 0
        while i < len(groups):
            if best[i] and (not best[i][0][0] or not any(b and not b[0][0] for b in best[i + 1 : best[i][1]])):
                out.append((groups[i][0], groups[best[i][1] - 1][1]))
                i = best[i][1]
            else:
                i += 1
        return out

    def spans(self):
        """(kind, start, end) of what is found, from the left."""
        i, out = 0, []
        while i < len(self.t):
            if found := self.other(i):
                out.append((found[0], i, found[1]))
                i = found[1]
            elif groups := self.run(i):
                # A run with less than 13 digits, dashes and all, holds no card; what follows it is looked at anew.
                out += [("card", a, b) for a, b in self.cards(groups)]
                i = groups[-1][1]
            else:
                i += 1
        return out


def op7(text, key):
    """The text with pseudonyms, and how many of each kind."""
    import datetime

    def noise(kind, step, size, half):
        return hashlib.sha512(f"{key}|{kind}|{step}|{size}|{half}".encode()).hexdigest()

    def shifted(half, hexes):
        out = []
        for i, c in enumerate(half):
            by = int(hexes[2 * (i % 64) : 2 * (i % 64) + 2], 16)
            kind = DIGIT if "0" <= c <= "9" else LOWER if "a" <= c <= "z" else UPPER if "A" <= c <= "Z" else None
            out.append(chr(ord(kind[0]) + (ord(c) - ord(kind[0]) + by) % kind[1]) if kind else c)
        return "".join(out)

    def chars(s, kind):
        a, b = s[: len(s) // 2], s[len(s) // 2 :]
        for r in range(1, 5):
            a = shifted(a, noise(kind, 2 * r, len(s), b))
            b = shifted(b, noise(kind, 2 * r + 1, len(s), a))
        return a + b

    def pair(v, n, m, kind):
        a, b = divmod(v, m)
        for r in range(1, 5):
            a = (a + int(noise(kind, 2 * r, n, b)[:14], 16)) % n
            b = (b + int(noise(kind, 2 * r + 1, m, a)[:14], 16)) % m
        return a * m + b

    only = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda s, double: sum(sum(divmod(int(c) * (2 if (i + double) % 2 else 1), 10)) for i, c in enumerate(reversed(s)))

    def refilled(old, digits):
        it = iter(digits)
        return "".join(next(it) if "0" <= c <= "9" else c for c in old)

    def new(kind, v):
        if kind == "email":
            user, host = v.split("@")
            return chars(user, kind) + "@" + host
        if kind == "phone":
            head = m[0] if (m := re.match(r"\+[0-9]{1,3}[ .-]?(?=\(?[0-9])", v)) else ""
            return head + refilled(v[len(head) :], chars(only(v[len(head) :]), kind)) if 8 <= len(only(v)) <= 15 else None
        if kind == "date":
            form = "%Y-%m-%d" if "-" in v else "%d.%m.%Y" if "." in v else "%m/%d/%Y"
            try:
                n = (datetime.datetime.strptime(v, form).date() - datetime.date(1800, 1, 1)).days
            except ValueError:
                return None
            if not 0 <= n < 146097:
                return None
            d = datetime.date(1800, 1, 1) + datetime.timedelta(pair(n, 189, 773, kind))
            return form.replace("%Y", f"{d.year:04}").replace("%m", f"{d.month:02}").replace("%d", f"{d.day:02}")
        if kind == "ssn":
            area, group, serial = v.split("-")
            if area in ("000", "666") or area >= "900" or group == "00" or serial == "0000":
                return None
            x = chars(group + serial, kind)
            return f"{area}-{x[:2]}-{x[2:]}"
        if kind == "ip":
            o = [int(x) for x in v.split(".")]
            if max(o) > 255:
                return None
            n = pair(int.from_bytes(bytes(o)), 65536, 65536, kind)
            return ".".join(str(x) for x in n.to_bytes(4))
        digits = only(v)
        body = digits[0] + chars(digits[1:-1], kind)
        return refilled(v, body + str(-luhn(body, 1) % 10))

    counts, done, before = Counter(), [], 0
    for kind, a, b in Finder(text or "").spans():
        made = new(kind, text[a:b])
        counts[kind] += made is not None
        done += [text[before:a], text[a:b] if made is None else made]
        before = b
    return (None if text is None else "".join(done) + text[before:], *(counts[k] for k in ("email", "phone", "card", "ip", "date", "ssn")))


def op11(rows, k=8, rounds=10, dims=64, salt="3"):
    """{row place: (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)} of (vec_id, vector) rows, one vector at a time."""
    kept = [(i, v, [math.floor(1024 * float(x)) for x in vec]) for i, (v, vec) in enumerate(rows) if vec is not None and len(vec) == dims and all(x is not None and math.isfinite(x) for x in vec)]
    seeds = sorted(kept, key=lambda r: (r[1] is None, hashlib.sha256(f"{salt}:{r[1]}".encode()).hexdigest() if r[1] is not None else "", r[2]))
    centroids = [list(q) for _, _, q in seeds[:k]]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, _, q in kept:
            groups[near(q)[1]].append(q)
        for j, qs in groups.items():
            centroids[j] = [sum(xs) // len(xs) for xs in zip(*qs, strict=True)]
    last = [(i, v, *near(q)) for i, v, q in kept]
    each = Counter()
    for _, _, d, j in last:
        each[j] += d
    return {i: (v, j, d, each[j], sum(each.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, v, d, j in last}


def op12(rows, most=8):
    """ids, deviations, whitened columns (either sign), explained shares of (vec_id, vector) rows of one length."""
    import numpy as np

    kept = [(v, [math.floor(1024 * float(x)) + 100000 for x in vec]) for v, vec in rows if vec and all(x is not None and math.isfinite(x) for x in vec)]
    n = len(kept)
    sums = [sum(xs) for xs in zip(*(x for _, x in kept), strict=True)]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for _, x in kept]
    held = np.array([x for _, x in kept], float) - np.array(sums, float) / n
    cov = held.T @ held / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    return [v for v, _ in kept], deviations, held @ vectors / np.sqrt(values), values / np.trace(cov)


def op13(texts, path, limit=1024):
    """(n_bytes, n_tokens, over_limit) of each text, one call of the library for each."""
    if path.endswith(".model"):
        import sentencepiece

        encode = sentencepiece.SentencePieceProcessor(model_file=path).encode
    else:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        encode = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    out = []
    for t in texts:
        n = len(encode(t or ""))
        out.append((len((t or "").encode()), n, n > limit))
    return out
