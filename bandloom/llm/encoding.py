"""Text that was decoded with the wrong character encoding: found, and restored where that can still be done.

Words are joined with their near-twins, the words that are the same once all
characters beyond ASCII are taken out; what has no letters of ASCII is joined by
the word before and the word after it. Twins are aligned at their ASCII
characters, and what stands between those in the one is mapped to what stands
there in the other. A mapping counts where encoding and decoding wrongly (once,
or twice in any two ways) turns the commoner spelling into the rarer one; the
confusions named that way are inferred from the aligned pairs. Mappings seen with
enough words are applied to all other texts, and the confusions behind them to
characters that no twin showed, as long as the outcome is made of characters
that clean text has.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from bandloom.common import maybe_broadcast
from bandloom.session import cut

#: Fixed values: (right encoding, wrong encoding) of the confusions looked for; each may have happened once or twice.
CONFUSIONS = tuple(("utf-8", wrong) for wrong in ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "cp866", "koi8-r", "iso8859-15", "cp1254", "iso8859-2")) + tuple(
    (right, wrong) for right in ("cp1252", "cp1251", "mac_roman", "cp850", "koi8-r", "iso8859-2") for wrong in ("cp437", "cp850", "mac_roman", "cp1252", "cp1251", "koi8-r", "cp1250", "latin-1") if right != wrong
)
_BEYOND = re.compile(r"[^\x00-\x7f]")
_LOST = re.compile("[�\x80-\x9f]")
#: Tables of codecs made so far; travels with the functions that use it.
_MADE: dict = {}


def _decode_table(codec: str) -> dict[int, str]:
    """The character of each byte; a byte that the codec leaves undefined stays the control character of its number."""
    if codec not in _MADE:
        out = {}
        for b in range(256):
            try:
                out[b] = bytes([b]).decode(codec)
            except UnicodeDecodeError:
                out[b] = chr(b)
        _MADE[codec] = out
    return _MADE[codec]


def _encode_table(codec: str) -> dict[str, int]:
    if ("back", codec) not in _MADE:
        _MADE["back", codec] = {c: b for b, c in _decode_table(codec).items()}
    return _MADE["back", codec]


def garble(text: str, right: str, wrong: str) -> str | None:
    """``text`` written as ``right`` and read as ``wrong``; None if ``right`` cannot write it."""
    table = _decode_table(wrong)
    if right == "utf-8":
        return "".join(table[b] for b in text.encode("utf-8", "surrogatepass"))
    codes = _encode_table(right)
    return "".join(table[codes[c]] for c in text) if all(c in codes for c in text) else None


def explanations(clean: str, seen: str) -> list[str]:
    """The confusions (as ``right>wrong``, two of them joined by ``|``) that turn ``clean`` into ``seen``; those of one step if there are any."""
    memo = _MADE.setdefault("explained", {})
    if (clean, seen) in memo:
        return memo[clean, seen]
    once, first = [], []
    for right, wrong in CONFUSIONS:
        g = garble(clean, right, wrong)
        if g == seen:
            once.append(f"{right}>{wrong}")
        elif g is not None and right == "utf-8" and g != clean:
            first.append((f"{right}>{wrong}", g))
    if not once:
        once = [f"{name}|{right}>{wrong}" for name, g in first for right, wrong in CONFUSIONS if garble(g, right, wrong) == seen]
    if len(memo) > 100_000:
        memo.clear()
    memo[clean, seen] = once
    return once


def aligned(clean: str, seen: str) -> list[tuple[str, str]]:
    """What differs between two spellings of equal ASCII characters (in any case): (of the clean one, of the other) from one ASCII character to the next."""
    a, b = (re.split(r"([\x00-\x7f])", t) for t in (clean, seen))
    if [c.lower() for c in a[1::2]] != [c.lower() for c in b[1::2]]:
        return []
    return [(x, y) for x, y in zip(a[::2], b[::2], strict=True) if x != y]


def explain(clean: str, seen: str) -> str | None:
    """The confusions that explain all aligned differences of ``clean`` and ``seen``: the first in the order of CONFUSIONS, or None."""
    parts = aligned(clean, seen)
    if not parts or any(not x or not y for x, y in parts):
        return None
    common = explanations(*parts[0])
    for x, y in parts[1:]:
        more = set(explanations(x, y))
        common = [c for c in common if c in more]
    return common[0] if common else None


def _learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for skeleton, form, twin in zip(b["skeleton"], b["form"], b["twin"], strict=True):
            chain = explain(twin, form)
            # One character of a byte for another proves little where only the neighbours are alike.
            if chain and (skeleton[:1] not in "<>" or chain.startswith("utf-8")):
                parts = aligned(twin, form)
                rows.append((skeleton, form, twin, chain, [y for _, y in parts], [x for x, _ in parts]))
        yield pd.DataFrame(rows, columns=["skeleton", "form", "twin", "chain", "seen", "clean"])


def _words(text: str) -> list[str]:
    """Words parted by blanks of ASCII: a blank beyond it may be part of a garbled character."""
    return [w for w in re.split(r"[ \t\n\r\f\v]+", text) if w]


def _bare(word: str) -> str:
    return re.sub(r"[.,;:()\[\]\"']+$|^[(\[\"']+", "", word)


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(skeleton, bare) of what has fewer than two letters of ASCII, by its neighbours: ``<`` and the word before, ``>`` and the word after."""
    for b in batches:
        rows = set()
        for n, text in enumerate(b["text"]):
            words = [_bare(w) for w in _words(text)]
            plain = [_BEYOND.sub("", w).lower() for w in words]
            for k, w in enumerate(words):
                if _BEYOND.search(w) and len(re.sub("[^a-z]", "", plain[k])) < 2:
                    near = ((f"<{plain[k - 1]}|{plain[k]}", k > 0 and len(plain[k - 1]) > 2), (f">{plain[k + 1] if k + 1 < len(words) else ''}|{plain[k]}", k + 1 < len(words) and len(plain[k + 1]) > 2))
                    rows.update((n, key, w) for key, there in near if there)
        yield pd.DataFrame([r[1:] for r in sorted(rows)], columns=["skeleton", "bare"])


def _multibyte(wrong: str) -> re.Pattern[str]:
    if ("multi", wrong) in _MADE:
        return _MADE["multi", wrong]
    t = _decode_table(wrong)
    some = lambda lo, hi: "[" + re.escape("".join(t[b] for b in range(lo, hi))) + "]"
    more = some(0x80, 0xC0)
    _MADE["multi", wrong] = re.compile(f"{some(0xC2, 0xE0)}{more}|{some(0xE0, 0xF0)}{more}{{2}}|{some(0xF0, 0xF5)}{more}{{3}}")
    return _MADE["multi", wrong]


def _script(c: str) -> str:
    o = ord(c)
    return "latin" if c.isascii() or o < 0x250 or 0x1E00 <= o < 0x1F00 else "greek" if 0x370 <= o < 0x400 else "cyrillic" if 0x400 <= o < 0x530 else "other"


def _mixed(word: str) -> bool:
    """Letters of two scripts side by side, or characters that draw frames."""
    pairs = zip(word, word[1:], strict=False)
    return any("\u2500" <= c <= "\u25ff" for c in word) or any(a.isalpha() and b.isalpha() and _script(a) != _script(b) for a, b in pairs)


def _odd(word: str, alphabet: frozenset[str], lone: frozenset[str]) -> bool:
    """Whether a character beyond ASCII stands where clean text has none like it."""
    alone = word.strip(".,;:()[]")
    if len(alone) == 1 and alone.isalpha() and not alone.isascii() and alone not in lone:
        return True
    for i, c in enumerate(word):
        if c.isascii():
            continue
        before, after = word[i - 1 : i] if i else "", word[i + 1 : i + 2]
        if c not in alphabet and (before.isalpha() or after.isalpha() or "\u2500" <= c <= "\u25ff"):
            return True
        if c.isalpha():
            near = [x for x in (before, after) if x and x.isalpha()]
            if any(_script(x) != _script(c) for x in near):
                return True
            if c.isupper() and before.islower() and (not after or after.islower()):
                return True
            # A small letter between capitals can't come from a word in capitals.
        elif before.isalpha() and after.isalpha() and c not in "’‘·'":
            return True
    return False


def _usual(c: str) -> bool:
    """A letter or sign of Latin, Greek or Cyrillic text; a capital before a closing quote reads as a rarer one."""
    return unicodedata.category(c) not in ("Cn", "Cc", "Co") and (0xA0 <= ord(c) < 0x250 or 0x370 <= ord(c) < 0x460 or 0x1E00 <= ord(c) < 0x2300)


def _swapped(word: str, twins: dict[str, str]) -> str:
    bare = re.sub(r"[.,;:()\[\]\"']+$|^[(\[\"']+", "", word)
    return word.replace(bare, twins[bare], 1) if bare in twins else word


def _fits(lost: str, twin: str) -> bool:
    """Whether ``twin`` is ``lost`` with each run of characters that holds lost ones read as one character beyond ASCII, or up to as many."""
    parts = re.split("([^\\x00-\\x7f]*\ufffd[^\\x00-\\x7f]*)", lost)
    pattern = "".join(f"[^\\x00-\\x7f]{{1,{len(p)}}}" if i % 2 else re.escape(p) for i, p in enumerate(parts))
    return re.fullmatch(pattern, twin) is not None


class Mender:
    """Applies learned mappings and undoes the confusions behind them.

    ``alphabet`` are the characters beyond ASCII of clean words, ``symbols`` those
    that stand alone or among figures, ``lone`` letters that stand alone in clean
    text, ``mapped`` what was seen of two or more characters and what it stands for.
    """

    def __init__(self, chains: list[str], alphabet: frozenset[str], symbols: frozenset[str] = frozenset(), lone: frozenset[str] = frozenset(), mapped: dict[str, str] | None = None):
        self.lone, self.mapped = lone, mapped or {}
        self.seen = re.compile("|".join(re.escape(x) for x in sorted(self.mapped, key=lambda x: (-len(x), x)))) if self.mapped else None
        steps = {s for c in chains for s in c.split("|")}
        self.multi = [w for r, w in CONFUSIONS if r == "utf-8" and f"{r}>{w}" in steps]
        self.single = [(r, w) for r, w in CONFUSIONS if r != "utf-8" and f"{r}>{w}" in steps]
        self.alphabet = alphabet
        self.allowed = alphabet | symbols
        # Inner garbling of text garbled twice is made of these.
        self.inner = self.allowed | frozenset(c for w in self.multi for c in _decode_table(w).values() if not c.isascii())

    def _undo(self, text: str, wrong: str, allowed: frozenset[str], wide: bool = False) -> tuple[str, int]:
        """``wide``: to characters of the usual scripts too, allowed or not."""
        codes, n = _encode_table(wrong), 0

        def one(m: re.Match[str]) -> str:
            nonlocal n
            try:
                c = bytes(codes[x] for x in m[0]).decode("utf-8")
            except (UnicodeDecodeError, KeyError):
                return m[0]
            if c not in allowed and not (wide and _usual(c)):
                return m[0]
            n += 1
            return c

        return _multibyte(wrong).sub(one, text), n

    def reversible(self, text: str) -> bool:
        """Whether ``text`` holds a sequence that strictly reads as another character, other than letters of one script side by side."""
        for wrong in self.multi:
            for m in _multibyte(wrong).finditer(text):
                one_script = m[0].isalpha() and len({_script(x) for x in m[0]}) == 1
                if not one_script and self._undo(m[0], wrong, frozenset(), wide=True)[1]:
                    return True
        return False

    def whole(self, text: str) -> bool:
        """Whether nothing in ``text`` is lost or still garbled."""
        return not (_LOST.search(text) or self.reversible(text) or any(self._undo(text, w, self.allowed)[1] for w in self.multi) or any(_mixed(w) for w in _words(text)))

    def _left(self, text: str) -> int:
        """How much in ``text`` still looks garbled."""
        words = [w for w in _words(text) if _BEYOND.search(w)]
        return len(_LOST.findall(text)) + sum(_odd(w, self.alphabet, self.lone) for w in words) + sum(self._undo(text, w, self.inner)[1] for w in self.multi)

    def _mend_words(self, text: str, odd: list[str]) -> tuple[str, bool]:
        """Garbled in part: odd words are mended one by one; mixed scripts and frames in words are garbled in any case."""
        back = {}
        for word in odd:
            for right, wrong in self.single:
                codes, table = _encode_table(wrong), _decode_table(right)
                if all(c in codes for c in word):
                    tried = "".join(table[codes[c]] for c in word)
                    if not _odd(tried, self.alphabet, self.lone):
                        back[word] = tried
                        break
        mended = re.sub(r"[^ \t\n\r\f\v]+", lambda m: back.get(m[0], m[0]), text)
        return mended, bool(back) or any(_mixed(w) for w in odd)

    def mend(self, text: str) -> tuple[bool, str]:
        """(whether it is garbled, the text as far as it can be restored)."""
        once, found = text, False
        for wrong in self.multi:
            n = self._undo(once, wrong, self.allowed)[1]
            if n:
                # A text that shows the confusion holds it elsewhere too, for whatever characters.
                found, once = True, self._undo(once, wrong, self.allowed, wide=True)[0]
        now, left = once, self._left(once)
        for wrong in self.multi if left or not found else ():
            inner, n = self._undo(text, wrong, self.inner)
            for again in self.multi if n else ():
                twice, m = self._undo(inner, again, self.allowed)
                if m and (not found or self._left(twice) < left):
                    found, now, left = True, twice, self._left(twice)
        if not found and not _LOST.search(text):
            words = [w for w in _words(text) if _BEYOND.search(w)]
            odd = [w for w in words if _odd(w, self.alphabet, self.lone)]
            if odd:
                for right, wrong in self.single:
                    codes, table = _encode_table(wrong), _decode_table(right)
                    if not all(c in codes for w in words for c in w):
                        continue
                    back = {w: "".join(table[codes[c]] for c in w) for w in words}
                    if not any(_odd(v, self.alphabet, self.lone) for v in back.values()):
                        found = True
                        now = re.sub(r"[^ \t\n\r\f\v]+", lambda m: back.get(m[0], m[0]), text)
                        break
                else:
                    now, found = self._mend_words(text, odd)
        # What the confusions behind them left, the mappings themselves may still tell.
        mapped = self.seen.sub(lambda m: self.mapped[m[0]], now) if self.seen else now
        return found or mapped != now or bool(_LOST.search(text)), mapped


def find_garbled(texts: DataFrame, keys: list[str], text: str = "text", min_words: int = 3, min_uses: int = 5) -> DataFrame:
    """(``keys``, text, restored, restorable) for each garbled row of ``texts``, once.

    ``min_words`` different words must show a confusion or a mapping before it is
    applied elsewhere, and ``min_uses`` clean words a character before it counts as
    one of clean text. ``restorable`` is false where characters were lost and no clean
    twin tells them, or a garbled sequence is left; ``restored`` then holds what could be mended. Null and empty
    texts and texts of ASCII only are never garbled. Rows that repeat count once,
    other columns are ignored, an empty table gives an empty result.
    """
    kept = texts.select(*keys, F.col(f"`{text}`").alias("text")).where(F.regexp_like("text", F.lit(r"[^\x00-\x7F]"))).distinct()
    kept = cut(kept)
    word = kept.select(F.explode(F.array_distinct(F.split(F.btrim("text", F.lit(" \t\n\r\f\v")), r"[ \t\n\r\f\x0B]+"))).alias("form")).where(F.regexp_like("form", F.lit(r"[^\x00-\x7F]")))
    forms = word.groupBy("form").agg(F.count("*").alias("n"))
    forms = forms.withColumn("skeleton", F.lower(F.regexp_replace("form", r"[^\x00-\x7F]|[.,;:()\[\]\"']+$|^[(\[\"']+", "")))
    forms = cut(forms.withColumn("bare", F.regexp_replace("form", r"[.,;:()\[\]\"']+$|^[(\[\"']+", "")).groupBy("skeleton", "bare").agg(F.sum("n").alias("n")))
    sound = ~F.regexp_like("bare", F.lit(r"[\x{80}-\x{9F}\x{FFFD}]"))
    # The twin is the commonest spelling of a skeleton: one row a skeleton, however many spellings share it.
    twins = forms.where(sound & (F.length(F.regexp_replace("skeleton", "[^a-z]", "")) >= 2)).groupBy("skeleton").agg(F.max_by("bare", F.struct("n", -F.length("bare"))).alias("twin"), F.max("n").alias("twin_n"))
    around = cut(kept.select("text").mapInPandas(_contexts, "skeleton string, bare string").groupBy("skeleton", "bare").agg(F.count("*").alias("n")))
    usual = around.where(sound).groupBy("skeleton").agg(F.max_by("bare", F.struct("n", -F.length("bare"))).alias("twin"), F.max("n").alias("twin_n"))
    differing = lambda f, t: f.join(t, "skeleton").where((F.col("bare") != F.col("twin")) & (F.col("n") <= F.col("twin_n"))).select("skeleton", F.col("bare").alias("form"), "twin")
    pairs = differing(forms, twins).unionByName(differing(around, usual))
    learned = cut(pairs.mapInPandas(_learn, "skeleton string, form string, twin string, chain string, seen array<string>, clean array<string>"))
    # At most as many rows as pairs of CONFUSIONS.
    chains = [r["chain"] for r in learned.groupBy("chain").agg(F.countDistinct("skeleton").alias("n")).where(F.col("n") >= min_words).collect()]
    used = learned.where(F.col("chain").isin(chains)) if chains else learned.limit(0)
    # At most as many rows as Unicode has characters: those that clean spellings use and garbled ones don't dominate.
    chars = (
        twins.select(F.explode(F.split(F.regexp_replace("twin", r"[\x00-\x7F]", ""), "")).alias("c"), F.col("twin_n").alias("n"))
        .where("c <> ''")
        .groupBy("c")
        .agg(F.sum("n").alias("clean"))
        .join(used.where(~F.regexp_like("skeleton", F.lit("^[<>]"))).select(F.explode(F.array_distinct(F.split(F.regexp_replace(F.concat_ws("", "seen"), r"[\x00-\x7F]", ""), ""))).alias("c")).where("c <> ''").groupBy("c").agg(F.count("*").alias("seen")), "c", "left")
    )
    alphabet = frozenset(r["c"] for r in chars.where(f"clean >= {min_uses} and clean > 4 * coalesce(seen, 0)").select("c").collect())
    # Characters that never stand in words of letters: dashes, signs. At most as many rows as Unicode has characters.
    plain = Mender(chains, alphabet)

    def lone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(c, n) for bare, n in zip(b["bare"], b["n"], strict=True) if not plain.reversible(bare) for c in set(_BEYOND.findall(bare)) if not c.isalpha() and not "\u2500" <= c <= "\u25ff"]
            yield pd.DataFrame(rows, columns=["c", "clean"])

    signs_of = forms.where(sound).mapInPandas(lone, "c string, clean long").groupBy("c").agg(F.sum("clean").alias("clean")).where(F.col("clean") >= min_uses).collect()
    # Letters that stand alone are those that some word before or after them has commonest, and that no confusion explains there as often.
    as_clean = usual.where(F.regexp_like("twin", F.lit(r"^[^\x00-\x7F]$"))).groupBy(F.col("twin").alias("c")).agg(F.countDistinct("skeleton").alias("clean"))
    as_seen = used.where(F.regexp_like("form", F.lit(r"^[^\x00-\x7F]$"))).groupBy(F.col("form").alias("c")).agg(F.countDistinct("skeleton").alias("seen"))
    lone_letters = as_clean.join(as_seen, "c", "left").where((F.col("clean") >= min_uses) & (F.col("clean") > 4 * F.coalesce(F.col("seen"), F.lit(0)))).select("c")
    # Mappings of one or two clean characters: no more than pairs of characters, each with the confusions that lead to it.
    shown = used.select("skeleton", F.explode(F.arrays_zip("seen", "clean")).alias("m")).select("skeleton", "m.seen", "m.clean").where((F.length("clean") <= 2) & (F.length("seen") >= 2) & (F.length("seen") > F.length("clean")))
    shown = shown.groupBy("seen", "clean").agg(F.countDistinct("skeleton").alias("n"))
    mapped = shown.groupBy("seen").agg(F.max_by("clean", F.struct("n", "clean")).alias("clean"), F.max("n").alias("top"), F.sum("n").alias("n")).where((F.col("top") >= min_words) & (F.col("top") >= 0.9 * F.col("n")))
    mappings = {r["seen"]: r["clean"] for r in mapped.collect() if set(r["clean"]) <= alphabet | {c["c"] for c in signs_of}}
    mender = Mender(chains, alphabet, frozenset(c["c"] for c in signs_of), frozenset(r["c"] for r in lone_letters.collect()), mappings)

    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [mender.mend(t) for t in b["text"]]
            b["garbled"], b["restored"] = [g for g, _ in done], [r for _, r in done]
            yield b

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", garbled boolean, restored string"
    by_rule = kept.mapInPandas(mend, schema)
    # Words with lost characters: of the frequent clean words of their skeleton just one may fit.
    good = forms.where(sound & (F.col("n") >= min_words)).join(used.select(F.col("form").alias("bare")).distinct(), "bare", "left_anti")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(lost, twin) for lost, twin in zip(b["lost"], b["twin"], strict=True) if _fits(lost, twin) and not mender.reversible(twin)]
            yield pd.DataFrame(rows, columns=["bare", "twin"])

    lost = forms.where(F.contains("bare", F.lit("\ufffd")) & F.regexp_like("skeleton", F.lit("[a-z].*[a-z]"))).select("skeleton", F.col("bare").alias("lost"))
    fitting = lost.join(good.select("skeleton", F.col("bare").alias("twin")), "skeleton").mapInPandas(fit, "bare string, twin string")
    told = fitting.groupBy("bare").agg(F.min("twin").alias("twin"), F.countDistinct("twin").alias("fits")).where("fits = 1").drop("fits")
    # Words that a clean twin and a learned confusion explain are garbled too, though nothing in them is odd.
    explained = used.select(F.col("form").alias("bare"), F.col("twin")).groupBy("bare").agg(F.min("twin").alias("twin"))
    explained = cut(explained.unionByName(told))
    words = kept.select(*keys, F.explode(F.array_distinct(F.split(F.btrim("text", F.lit(" \t\n\r\f\v")), r"[ \t\n\r\f\x0B]+"))).alias("form")).where(F.regexp_like("form", F.lit(r"[^\x00-\x7F]")))
    words = words.withColumn("bare", F.regexp_replace("form", r"[.,;:()\[\]\"']+$|^[(\[\"']+", ""))
    by_twin = words.join(maybe_broadcast(explained, 256), "bare").groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("bare", "twin"))).alias("swaps"))
    both = by_rule.join(by_twin, keys, "left").where("garbled or swaps is not null").select(*keys, "text", F.when(F.col("garbled"), F.col("restored")).otherwise(F.col("text")).alias("restored"), F.to_json("swaps").alias("swaps"))

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, swaps in zip(b["restored"], b["swaps"], strict=True):
                twins = json.loads(swaps) if swaps else {}
                out.append(re.sub(r"[^ \t\n\r\f\v]+", lambda m: _swapped(m[0], twins), text) if twins else text)
            b["restored"], b["restorable"] = out, [mender.whole(t) for t in out]
            yield b.drop(columns="swaps")

    return both.mapInPandas(finish, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema if f.name != "swaps") + ", restorable boolean")
