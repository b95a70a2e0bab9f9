"""Plain Python versions of the operators, for small inputs."""

import re
from collections import Counter, defaultdict

WORD = "[^\x20\x09-\x0d]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, words):
    w = re.findall(WORD, (text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < words else (tuple(w[i : i + words]) for i in range(len(w) - words + 1)))


def near_groups(rows, words, num, den):
    """id to (set size, smallest id of its component)."""
    sets = [(i, shingles(t, words)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for e in s:
            held[e].append(k)
    for k, (i, s) in enumerate(sets):
        met = Counter(j for e in s for j in held[e] if j < k)
        for j, n in met.items():
            if den * n >= num * (len(s) + len(sets[j][1]) - n):
                a, b = find(i), find(sets[j][0])
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets}


def alignment(a, b, match=2, miss=-1, gap=-1):
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (match if x == y else miss), row[j + 1] + gap, new[j] + gap))
        row = new
        best = max(best, *row)
    return best


def greedy_pieces(word, vocabulary, end="</w>"):
    """Pieces of greedy longest match; a mark alone is none, an unknown sign is one."""
    units, n, i = [*word, end], 0, 0
    while i < len(units):
        for j in range(len(units), i, -1):
            if "".join(units[i:j]) in vocabulary and units[i:j] != [end]:
                n, i = n + 1, j
                break
        else:
            n, i = n + (units[i] != end), i + 1
    return n


def repeated_words(words, width=8):
    grams = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
    count = Counter(grams)
    covered = set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered.update(range(i, i + width))
    return len(covered)


def grams(text):
    """All n-grams of one to three characters, each as often as it occurs."""
    t = (text or "").lower()
    return Counter(t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1))


def bucket(gram, bits=15):
    """The bucket of an n-gram: the multiplications of the operator, on plain integers."""
    h, full = len(gram), (1 << 32) - 1
    for c in gram:
        h = (h ^ ord(c)) * 0x01000193 & full
        h ^= h >> 15
    return (h * 0x9E3779B1 & full) >> (32 - bits)


def naive_bayes(learn, texts, scores=False):
    """The most likely language of each text, from whole counts; learn: (text, language). With ``scores`` also the
    probability when the evidence is flattened to a hundred n-grams."""
    import math

    counts, docs = defaultdict(Counter), Counter()
    for t, lang in learn:
        docs[lang] += 1
        for g, n in grams(t).items():
            counts[lang][bucket(g)] += n
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    out = []
    for t in texts:
        own = Counter()
        for g, n in grams(t).items():
            own[bucket(g)] += n
        score = {lang: math.log(docs[lang] / len(learn)) + sum(n * math.log((counts[lang][b] + 0.5) / (total[lang] + 0.5 * (1 << 15))) for b, n in own.items()) for lang in docs}
        best = max(sorted(score), key=score.get)
        lang = best if any(c.isalpha() for c in t or "") else "und"
        flat = min(1.0, 100 / max(1, sum(own.values())))
        out.append((lang, 1 / sum(math.exp((s - score[best]) * flat) for s in score.values()) if lang != "und" else 0.0) if scores else lang)
    return out


def leaks(text, items, least=0.5):
    """Whether a text contains an item of three words or more: each is aligned with all of it."""
    plain = lambda t: [w for w in (re.sub(r"^\W+|\W+$", "", x.lower()) for x in (t or "").split()) if w]
    w = plain(text)
    return any(alignment(i, w) >= least * 2 * len(i) for i in map(plain, items) if len(i) >= 3)


def copies(rows):
    """How often systematic sampling takes each (id, text, source): sources weigh 5, 2, 1 by name, none more than twice its size."""
    import hashlib

    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    size = lambda t: len(re.findall(WORD, t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    goal, open_ = {}, set(sizes)
    while open_:
        level = (1.5 * sum(sizes.values()) - sum(goal.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        goal |= {s: 2.0 * sizes[s] if over else level * weight[s] for s in over or open_}
        open_ -= over or set(open_)
    out = {}
    for s in sizes:
        u = int(md5("mix:" + ("null:" if s is None else "of:" + s))[:8], 16) / 2**32

        def place(row):
            i, t, _ = row
            bits = bin(size(t))[2:]
            tie = md5(t or "")
            return len(bits) * 4 + int((bits[1:3] + "00")[:2], 2), int(md5(f"{'' if i is None else i}:{tie}")[:8], 16) % 256, size(t), i is None, i, tie

        rate = goal[s] / sizes[s] if sizes[s] else 0.0
        for r, row in enumerate(sorted((x for x in rows if x[2] == s), key=place), 1):
            out[row] = int(r * rate + u) - int((r - 1) * rate + u)
    return out


def compressed(text):
    """Whether the bands of compression keep a text: its whole, and all but a fifth of its chunks."""
    import zstandard

    from quillgraph.llm import quality_rules as q

    def inside(data):
        low, high = next((a, b) for upto, a, b in q.BANDS if len(data) <= upto)
        return low <= len(data) / len(zstandard.ZstdCompressor(level=q.LEVEL).compress(data)) <= high

    data = text.encode()
    chunks = [data[i : i + 2_048] for i in range(0, len(data), 2_048)]
    if len(chunks) > 1 and len(chunks[-1]) < 1_024:
        chunks[-2:] = [chunks[-2] + chunks[-1]]
    odd = sum(not inside(c) for c in chunks) if len(data) >= 4_096 else 0
    return inside(data) and odd <= 0.2 * len(chunks)


def article(html):
    """The blocks of a page's one article element, read with the standard library's parser."""
    from html.parser import HTMLParser

    blocks, inside = [""], [False]

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            inside[0] |= tag == "article"
            if tag not in ("b", "a"):
                blocks.append("")

        def handle_endtag(self, tag):
            inside[0] &= tag != "article"
            if tag not in ("b", "a"):
                blocks.append("")

        def handle_data(self, data):
            if inside[0]:
                blocks[-1] += data

    Reader(convert_charrefs=True).feed(html or "")
    return " ".join(x for x in (re.sub(r"\s+", " ", b).strip() for b in blocks) if x)


def machine_score(machine, row, metadata=()):
    """The score of one row, pair by pair, from features that are counted word by word."""
    import math

    import xxhash

    from quillgraph.llm import quality_fm as fm

    t = row["text"] or ""
    w = re.findall(WORD, t.translate(LOWER))
    count = Counter(xxhash.xxh64_intdigest(x) % fm.WORDS for x in w)
    norm = math.sqrt(sum(math.log1p(n) ** 2 for n in count.values())) or 1
    x = [(k, math.log1p(n) / norm) for k, n in count.items()]
    n, size, lines = len(w), max(len(t), 1), t.count("\n") + 1
    filled = [y for y in t.split("\n") if re.search(WORD, y)]
    share = lambda pattern: len(re.findall(pattern, t)) / size
    stats = [math.log1p(n) / 8, math.log1p(len(t)) / 10, sum(map(len, w)) / max(n, 1) / 10, len(count) / max(n, 1), min(1, 20 * share(r"[#*$%&|<>]")), share("[A-Z]"), share("[a-z]"), min(1, 10 * share("[0-9]")), min(1, 30 * share(r"[.?]")), min(1, 30 * share("!")), min(1, 20 * share(r"\|")), min(1, 5 * lines / max(n, 1)), (len(filled) - len(set(filled))) / lines, float(n == 0)]
    x += [(fm.WORDS + k, v) for k, v in enumerate(stats)]
    x += [(xxhash.xxh64_intdigest(c if isinstance(row[c], (int, float)) else f"{c}={row[c]}") % fm.WORDS, math.log1p(row[c]) / 10 if isinstance(row[c], (int, float)) else 1.0) for c in metadata if row[c] is not None]
    margin = machine.bias + sum(machine.linear[k] * v for k, v in x)
    margin += sum(float(machine.factors[a] @ machine.factors[b]) * u * v for i, (a, u) in enumerate(x) for b, v in x[:i])
    return 1 / (1 + math.exp(-margin))
