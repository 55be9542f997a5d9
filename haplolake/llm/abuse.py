"""Abusive, hateful or sexual language: Levenshtein automata over a lexicon trie, scored in context windows.

Each distinct word of a batch is folded (case, accents, look-alike letters, digits and signs that
stand for letters, stretched letters, spaced-out letters) and, with the edits its length permits,
walked through the lexicon's trie together with the Levenshtein automaton of the word; a masked letter
matches any. Results are remembered, so the walk happens once per distinct word and worker.

The lexicon is general vocabulary in classes: insults that are abuse by themselves, insults that need
an aim, comparisons that degrade people, words of harm, of wishing, of groups, of explicit sex, of
quotation. What counts is their company in a window: a word of harm next to the person addressed, a
degrading comparison next to a group, and so on; words of quotation or court reporting weigh against.
Every feature of a window has a weight, and a text scores as its worst window does.

Marked texts, if there are any, teach it more: words and pairs of words that go with the marks join the
lexicon. How sure such a feature is follows from the share of marked texts among those that have it,
beyond the usual share (a marked text has sober words too); texts that are marked for another window's
sake, such as those with a chair's rebuke, are left out of that count. One feature may be chance, so a
window counts as its third surest one does.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import small_slices, split_words

#: words of a window, of a step from one window to the next, and within which two words are company
WINDOW, STEP, NEAR = 12, 6, 6
#: score from which a text counts as abusive
THRESHOLD = 0.5
#: labelled texts that a model is fitted on at most
SAMPLE = 10_000
#: least texts that a learned word or pair stands in, and least log-likelihood ratio of its link with the marks
LEAST_TEXTS, WORD_RATIO, PAIR_RATIO = 4, 10.0, 14.0
#: a window counts as its so manieth surest learned feature; from this sureness on it counts as abusive
CORROBORATED, SURE = 3, 0.8
#: what a word of quotation in the window takes from learned features (log odds)
QUOTED = 2.0

# fixed values: the lexicon, as plain words in classes
CLASSES = {
    "insult": """asshole arsehole motherfucker cunt cunts dickhead shithead fuckwit fuckface
twat wanker tosser scumbag dipshit dumbass jackass douchebag halfwit imbecile moron cretin idiot
retard retards retarded degenerate degenerates subhuman bastards untermensch untermenschen arschloch wichser hurensohn
fotze schlampe missgeburt drecksau drecksack scheisskerl mistkerl miststück vollidiot spast schwachkopf
hohlkopf abschaum gesindel idioten connard connasse enculé salaud salope enfoiré abruti crétin
débile imbécile imbéciles pourriture""",
    "slur": """nigger faggot fag fags kike kikes spic chink chinks gook wetback tranny raghead  towelhead
dyke dykes paki pakis kanake kanaken neger schwuchtel bougnoule youpin bamboula nègre pédale tapette""",
    "degrading": """vermin rat rats cockroach maggot maggots parasite parasites leech leeches plague disease scum filth trash garbage savages
animals beasts swine cancer ungeziefer ratte ratten kakerlake maden parasiten schmarotzer pest seuche dreck abfall wilde wilden
tiere bestien vieh vermine cafard cafards sangsues peste maladie crasse racaille sauvages animaux bêtes déchets """,
    "aimed": """liar pig pigs cow bitch bitches bastard prick pricks ass arse coward clown fool whore whores slut sluts snake toad dog scum filth parasite rat
traitor swine lügner lügnerin schwein schweine kuh hund hure huren feigling trottel depp narr sau ratte verräter menteur menteuse porc porcs vache
chien lâche con conne cons putain pute truie traître bouffon ordure ordures fumier """,
    "harm": """kill killed hang hanged shoot shot beat burn burned burnt stab strangle drown gas gassed exterminate exterminated lynch rape choke chokes
dead bullet rope neck töten tötet umbringen erschiessen aufhängen hängen häng verbrennen brennen erwürgen ersticken erstickt verrecken
verrecke krepieren krepier vergasen ausrotten vergewaltigen prügeln sterben stirb verrotten kugel strick tuer tue pendre pends crever crève
brûler brûlez noyer étrangler étouffer exterminer gazer violer tabasser mourir pourrir balle corde""",
    "wish": """hope hopes wish deserve deserves should ought somebody someone gonna going hoffe hoffentlich wünsche verdient verdienst sollte sollten jemand werde
espère souhaite mérite mérites mériterait devrait devraient quelqu vais""",
    "you": """you your youre yourself yourselves du dich dir dein deine euch ihr eure tu te toi vous votre""",
    "them": """them they these those him her ihnen ihn diese diesen denen eux ces ceux leur""",
    "group": """immigrants immigrant migrants migrant foreigners foreigner refugees women jews jew muslims muslim blacks gays homosexuals gypsies arabs asians africans
lesbians cripples disabled ausländer zuwanderer flüchtlinge frauen weiber juden muslime schwarze schwarzen schwule zigeuner araber
behinderte behinderten krüppel  étrangers immigrés migrants réfugiés femmes juifs musulmans noirs arabes homosexuels gitans
""",
    "equating": """are were sind waren sont étaient nothing but nichts als""",
    "address": """what such bloody damned filthy lying stupid dumb stinking dirty worthless gutless stinkende dreckige dreckiger dreckiges blöde blöder
blödes dumme dummer dummes verlogene verlogener verlogenes verdammte verdammter verdammtes elende elender elendes quel quelle espèce sacré sacrée stupide""",
    "explicit": """fuck fucks fucking fucked blowjob cum cumming pussy tits titties horny jerkoff handjob deepthroat gangbang ficken fick gefickt titten
muschi geil geile wichsen bumsen vögeln nichons baiser baise baiserais sucer suce suces bander chatte enculer niquer nique branler""",
    "bodily": """naked nude suck sucks lick licks cock cocks dick dicks moan moans bed knees strip breasts thighs legs sex porn penis undress nackt nackte lecken
leck stöhnt stöhnen brüste schwanz porno pornos bett knie beine blasen ausziehen nue nues lèche lécher bite bites seins cuisses gémit lit genoux
déshabille""",
    "quoting": """quoted quotes quote quoting convicted sentenced verdict court indictment reported report zitat zitiere zitiert verurteilt urteil gericht
bericht citation cité cite condamné condamnée jugement tribunal rapport""",
}
# fixed values: plain weights (log odds) of a class, of two classes near each other (+), of one just before the other (>)
PLAIN = {
    "insult": 4.5, "slur": 4.5, "explicit": 4.0, "degrading": -0.5, "aimed": -1.0, "harm": -0.5, "bodily": -0.5,
    "address>aimed": 5.0, "you>aimed": 4.5, "address>degrading": 2.5, "degrading+group": 1.5, "degrading+equating": 1.0, "equating>degrading": 1.5, "degrading+them": 0.8, "degrading+you": 1.2,
    "harm+you": 1.5, "harm>you": 3.0, "you>harm": 0.5, "harm+group": 2.2, "harm>group": 2.0, "harm+them": 0.8, "harm>them": 0.8, "harm+wish": 1.0,
    "bodily+you": 1.5, "bodily+bodily": 2.5, "aimed+group": 1.5, "explicit+you": 0.5,
    "insult+quoting": -3.5, "slur+quoting": -3.5, "explicit+quoting": -3.0, "harm+quoting": -3.0, "degrading+quoting": -2.0, "aimed+quoting": -2.5, "bodily+quoting": -2.5,
}
BIAS = -3.0
CORE_CLASSES = ("insult", "slur", "degrading", "aimed", "harm", "explicit", "bodily")
KIND_OF_CLASS = {"insult": "abuse", "aimed": "abuse", "harm": "abuse", "slur": "hate", "degrading": "hate", "explicit": "sexual", "bodily": "sexual"}

_LOOKALIKE = str.maketrans("аеорсухіѕјкмтнвԁɡαερινοκτυ013457$@!8€+|", "aeopcyxisjkmthbdgaepivokt" + "u" + "oieastsaibetl")
_FORMS = str.maketrans({"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l"})
_ANY = "*"
_BETWEEN = r"[^\p{L}\p{N}*@$!€+|\x{301}\x{308}-]+"


def fold(word: str) -> str:
    """Plain letters of a word, without what disguises them."""
    word = unicodedata.normalize("NFKD", word.translate(_FORMS))
    return "".join(c for c in word if not unicodedata.combining(c))


def unmask(word: str) -> tuple[str, bool]:
    """The folded word with look-alikes replaced and stretches shortened, and whether any disguise was found."""
    plain = fold(word).strip("!|+")
    open_ = "".join(_ANY if c in "*#_" else c for c in plain.translate(_LOOKALIKE))
    short: list[str] = []
    for c in open_:
        if len(short) < 2 or not (short[-1] == short[-2] == c):
            short.append(c)
    out = "".join(short)
    stretched = len(out) < len(open_)
    if stretched:
        out = "".join(c for k, c in enumerate(out) if not k or c != out[k - 1])
    return out, stretched or open_ != plain or _ANY in out


def permitted(length: int, disguised: bool) -> int:
    """Edits that a term of this length may differ by."""
    if disguised:
        return 0 if length < 4 else 1 if length < 9 else 2
    return 0 if length < 6 else 1 if length < 10 else 2


def inflected(term: str, verb: bool) -> list[str]:
    """A term with its regular plural and, of verbs, its other regular forms."""
    plural = term + ("es" if term.endswith(("s", "x", "ch", "sh")) else "s")
    stem = term.removesuffix("e")
    return [term, plural, *([stem + "ed", stem + "ing"] if verb and len(term) > 3 else [])]


class Lexicon:
    """Terms in a trie; ``find`` intersects it with the Levenshtein automaton of a word.

    ``loose`` terms may be met with edits, the others only as they are written; ``usual`` words are no
    misspellings of any.
    """

    def __init__(self, loose: list[str], exact: list[str], usual: list[str]) -> None:
        self.usual = set(usual)
        self.terms = list(dict.fromkeys([*loose, *exact]))
        self.number = {t: k for k, t in enumerate(self.terms)}
        self.root: dict = {}
        for term in dict.fromkeys(loose):
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = self.number[term]
        self.memo: dict[str, int] = {}

    def find(self, word: str) -> int:
        """Number of the closest term within the edits permitted, -1 if there is none."""
        hit = self.memo.get(word)
        if hit is None:
            if len(self.memo) > 2_000_000:
                self.memo.clear()
            hit = self.memo[word] = self._find(word)
        return hit

    def _find(self, word: str) -> int:
        if "-" in word:  # a hyphen may be put into a word to hide it, or join two
            parts = [p for p in word.split("-") if p]
            found = self.find("".join(parts)) if len(parts) > 1 else -1
            return found if found >= 0 else next((n for p in parts if (n := self.find(p)) >= 0), -1)
        plain = fold(word)
        if plain in self.number:
            return self.number[plain]
        if plain in self.usual or not plain or plain.isdigit() or len(plain) > 40:
            return -1
        open_, disguised = unmask(word)
        if open_ in self.number:
            return self.number[open_]
        if len(open_) < (3 if disguised else 4) or sum(c.isalpha() for c in open_) < 2:
            return -1
        # several masks in a row mostly stand for one letter
        found = self._walk(re.sub(r"\*+", _ANY, open_), True) if _ANY * 2 in open_ else -1
        return found if found >= 0 else self._walk(open_, disguised)

    def _walk(self, open_: str, disguised: bool) -> int:
        best, found = 99, -1
        most = permitted(len(open_), disguised)
        if not disguised and not most:
            return -1
        # the automaton's state is the row of edit counts; it dies when no count is within what is permitted
        first = list(range(len(open_) + 1))
        if disguised:
            stack = [(self.root, first, 0)]
        else:  # an undisguised word keeps its first letter
            child = self.root.get(open_[0])
            stack = [(child, [1, 0, *first[1:-1]], 1)] if child is not None else []
        while stack:
            node, row, depth = stack.pop()
            end = node.get("")
            if end is not None and row[-1] < best and row[-1] <= permitted(min(depth, len(open_)), disguised):
                best, found = row[-1], end
            for c, child in node.items():
                if c == "":
                    continue
                new = [row[0] + 1]
                for k, w in enumerate(open_):
                    new.append(min(new[-1] + 1, row[k + 1] + 1, row[k] + (w != c and w != _ANY)))
                if min(new) <= most:
                    stack.append((child, new, depth + 1))
        return found


# --- windows and their features ---------------------------------------------------------------

#: classes and words are symbols; a feature is a symbol, a pair near each other (+) or one just before the other (>)
_SYMBOLS = 1 << 20
_ALONE, _NEAR, _BEFORE = 0, 1, 2
_CLASS = {c: k for k, c in enumerate(CLASSES)}


def _code(kind: int, one, two):
    return (kind * _SYMBOLS + one) * _SYMBOLS + two


def plain_weights() -> dict[int, float]:
    out = {}
    for name, weight in PLAIN.items():
        for sign, kind in (("+", _NEAR), (">", _BEFORE)):
            if sign in name:
                one, two = (_CLASS[c] for c in name.split(sign))
                out[int(_code(kind, *(sorted((one, two)) if kind == _NEAR else (one, two))))] = weight
                break
        else:
            out[int(_code(_ALONE, _CLASS[name], 0))] = weight
    return out


class Model:
    """The lexicon, each term's symbols, and the weights of features; small enough to travel with a task.

    ``core`` are the learned words that open a window (with the kind they are of), ``company`` those that count
    only near one that does, ``learned`` the log odds of learned features, ``usual`` words seen too often to be misspelt.
    """

    def __init__(self, core: dict[str, str] | None = None, company: list[str] | None = None, learned: dict[int, float] | None = None, usual: list[str] | None = None):
        self.parts = (core, company, learned, usual)
        core = core or {}
        classes: dict[str, list[int]] = {}
        for name, words in CLASSES.items():
            for w in words.split():
                for form in inflected(fold(w), name in ("harm", "explicit", "bodily")) if name in CORE_CLASSES else [fold(w)]:
                    own = classes.setdefault(form, [])
                    if _CLASS[name] not in own:
                        own.append(_CLASS[name])
        cores = {_CLASS[c] for c in CORE_CLASSES}
        loose = [fold(w) for c in CORE_CLASSES for w in CLASSES[c].split()] + list(core)
        self.lexicon = Lexicon(loose, [*classes, *(company or [])], usual or [])
        self.kinds = [KIND_OF_CLASS.get(c, "abuse") for c in CLASSES]
        self.symbols: list[list[int]] = []  # of every term: its classes, and the term itself if it was learned
        own = {w: len(CLASSES) + k for k, w in enumerate(dict.fromkeys([*core, *(company or [])]))}
        for t in self.lexicon.terms:
            self.symbols.append(sorted(classes.get(t, [])) + ([own[t]] if t in own else []))
        self.words = list(own)
        self.kinds += [core.get(w, "abuse") for w in own]
        self.opens = np.zeros(len(CLASSES) + len(own) + 1, bool)  # the last entry stands for no symbol
        self.opens[[*cores, *(own[w] for w in core)]] = True
        self.wide = max((len(s) for s in self.symbols), default=1) or 1
        self.table = np.full((len(self.symbols) + 1, self.wide), -1, np.int64)
        for k, own in enumerate(self.symbols):
            self.table[k, : len(own)] = own
        plain = plain_weights()
        self.codes = np.array(sorted({*plain, *(learned or {})}), np.int64)
        self.weights = np.array([plain.get(c, 0.0) for c in self.codes.tolist()])
        #: log odds beyond the sureness asked for
        self.learned = np.array([(learned or {}).get(c, -np.inf) for c in self.codes.tolist()])
        quoting = _CLASS["quoting"]
        self.quotes = np.isin((self.codes // _SYMBOLS) % _SYMBOLS, quoting) | np.isin(self.codes % _SYMBOLS, quoting) & (self.codes >= _SYMBOLS**2)

    def features(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, window, code) of every feature in a window that holds an opening symbol; none twice."""
        terms, starts = find_terms(self.lexicon, texts)
        empty = np.zeros(0, np.int64)
        sym = self.table[terms]
        text_of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        place = np.arange(terms.size) - starts[text_of]
        opening = self.opens[sym].any(1) if terms.size else np.zeros(0, bool)
        at = np.flatnonzero(opening)
        found: list[np.ndarray] = []

        def add(first: np.ndarray, last: np.ndarray, code: np.ndarray) -> None:
            # the windows that hold both places: those that begin at first // STEP and the steps before
            for back in range(WINDOW // STEP):
                window = place[first] // STEP - back
                ok = (window >= 0) & (place[last] < window * STEP + WINDOW)
                found.append(np.stack((text_of[first][ok], window[ok], code[ok])))

        for a in range(self.wide):
            one = sym[at, a]
            use = self.opens[one] & (one >= 0)
            add(at[use], at[use], _code(_ALONE, one[use], 0))
            for step in [*range(-NEAR, 0), *range(1, NEAR + 1)]:
                other = at[use] + step
                inside = (other >= 0) & (other < terms.size)
                own, o = at[use][inside], other[inside]
                same = text_of[own] == text_of[o]
                own, o, mine = own[same], o[same], one[use][inside][same]
                for b in range(self.wide):
                    two = sym[o, b]
                    real = two >= 0
                    x, y, m, t = own[real], o[real], mine[real], two[real]
                    first, last = np.minimum(x, y), np.maximum(x, y)
                    add(first, last, _code(_NEAR, np.minimum(m, t), np.maximum(m, t)))
                    if abs(step) <= 2:
                        add(first, last, _code(_BEFORE, np.where(step < 0, t, m), np.where(step < 0, m, t)))
        if not found:
            return empty, empty, empty
        text, window, code = np.concatenate(found, axis=1)
        order = np.lexsort((code, window, text))
        text, window, code = text[order], window[order], code[order]
        new = np.concatenate(([True], (text[1:] != text[:-1]) | (window[1:] != window[:-1]) | (code[1:] != code[:-1]))) if text.size else np.zeros(0, bool)
        return text[new], window[new], code[new]

    def windows(self, text: np.ndarray, window: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log odds of every window of sorted features, its first feature and their number."""
        at = np.minimum(np.searchsorted(self.codes, code), self.codes.size - 1)
        known = self.codes[at] == code
        weight, learned = np.where(known, self.weights[at], 0.0), np.where(known, self.learned[at], -np.inf)
        if not text.size:
            return np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (window[1:] != window[:-1]))))
        size = np.diff(np.append(first, text.size))
        # the third surest learned feature
        order = np.lexsort((-learned, np.repeat(np.arange(first.size), size)))
        third = np.where(size >= CORROBORATED, learned[order][np.minimum(first + CORROBORATED - 1, text.size - 1)], -np.inf)
        quoted = np.logical_or.reduceat(known & self.quotes[at], first)
        return np.maximum(BIAS + np.add.reduceat(weight, first), third - QUOTED * quoted), first, size

    def score(self, texts: pa.Array) -> tuple[np.ndarray, list[str | None]]:
        """Score and kind of every text: those of its worst window; 0 and None without an opening word."""
        text, window, code = self.features(texts)
        scores, kinds = np.zeros(len(texts)), [None] * len(texts)
        if not text.size:
            return scores, kinds
        log_odds, first, size = self.windows(text, window, code)
        at = np.minimum(np.searchsorted(self.codes, code), self.codes.size - 1)
        known = self.codes[at] == code
        weight, learned = np.where(known, self.weights[at], 0.0), np.where(known, self.learned[at], -np.inf)
        value = 1 / (1 + np.exp(-log_odds))
        owner = text[first]
        worst = np.lexsort((-value, owner))
        worst = worst[np.concatenate(([True], owner[worst][1:] != owner[worst][:-1]))]
        ends = first + size
        for k in worst.tolist():
            scores[owner[k]] = round(float(value[k]), 6)
            mine = slice(first[k], ends[k])
            lead = int(code[mine][np.argmax(np.maximum(weight[mine], learned[mine]))])
            one, two = (lead // _SYMBOLS) % _SYMBOLS, lead % _SYMBOLS
            kinds[owner[k]] = self.kinds[one if self.opens[one] else two]
        return scores, kinds


def find_terms(lexicon: Lexicon, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of each word's term (-1 for other words), and each text's first word (and the end)."""
    words, starts = split_words(texts, _BETWEEN)
    dictionary = words.dictionary.to_pylist()
    term = np.array([lexicon.find(w) for w in dictionary], np.int32)
    single = np.array([len(w) == 1 and w.isalpha() for w in dictionary], bool)
    code = words.indices.to_numpy()
    terms = term[code] if code.size else np.zeros(0, np.int32)
    # letters set apart: four or more one-letter words in a row are read as one
    alone = single[code] if code.size else np.zeros(0, bool)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], alone.view(np.int8), [0]))))
    for a, z in zip(edge[::2], edge[1::2], strict=True):
        if z - a >= 4:
            joined = lexicon.find("".join(dictionary[c] for c in code[a:z]))
            if joined < 0 and z - a > 4:  # an article or the like may stand before or after
                joined = max(lexicon.find("".join(dictionary[c] for c in code[a + 1 : z])), lexicon.find("".join(dictionary[c] for c in code[a : z - 1])))
            if joined >= 0:
                terms[a] = joined
    return terms, starts


# --- fitting ----------------------------------------------------------------------------------


def link_ratio(marked: np.ndarray, other: np.ndarray, all_marked: int, all_other: int) -> np.ndarray:
    """Log-likelihood ratio of the link between a thing's texts and the marks, negative where marks are rarer than elsewhere."""

    def part(k: np.ndarray, n: float, p: np.ndarray) -> np.ndarray:
        return np.where(k > 0, k * np.log(np.maximum(p, 1e-12)), 0) + np.where(n - k > 0, (n - k) * np.log(np.maximum(1 - p, 1e-12)), 0)

    p = (marked + other) / (all_marked + all_other)
    p1, p2 = marked / max(all_marked, 1), other / max(all_other, 1)
    ratio = 2 * (part(marked, all_marked, p1) + part(other, all_other, p2) - part(marked, all_marked, p) - part(other, all_other, p))
    return np.where(p1 > p2, ratio, -ratio)


def _counted(keys: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values, at = np.unique(keys, return_inverse=True)
    n = np.bincount(at, minlength=values.size)
    m = np.bincount(at, weights=marked, minlength=values.size).astype(np.int64)
    return values, m, n - m


def _merged(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return values, *(np.bincount(at, weights=np.concatenate([p[c] for p in parts]), minlength=values.size).astype(np.int64) for c in (1, 2))


def learned_words(texts: list[str], marked: np.ndarray, kinds: list[str | None]) -> tuple[dict[str, str], list[str], list[str]]:
    """(core words with their kind, words of their company, usual words): what goes with marked texts, alone or in pairs."""
    base = Model()
    words, starts = split_words(pa.array(texts, pa.string()), _BETWEEN)
    names = [base.lexicon.terms[t] if (t := base.lexicon.find(w)) >= 0 else fold(w) for w in words.dictionary.to_pylist()]
    vocabulary, number = np.unique(np.array(names or [""]), return_inverse=True)
    word = number[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
    text_of = np.repeat(np.arange(len(texts)), np.diff(starts))
    seen = np.unique(text_of * vocabulary.size + word)
    alone = _counted(seen % vocabulary.size, marked[seen // vocabulary.size])
    all_marked, all_other = int(marked.sum()), int((~marked).sum())
    count = np.zeros(vocabulary.size, np.int64)
    count[alone[0]] = alone[1] + alone[2]
    ratio = link_ratio(alone[1], alone[2], all_marked, all_other)
    ok = (ratio >= WORD_RATIO) & (alone[1] >= LEAST_TEXTS)
    core = set(alone[0][ok].tolist())
    usual = (count >= LEAST_TEXTS) & np.array([len(v) > 1 and not v.isdigit() for v in vocabulary.tolist()])
    parts = []
    for low in range(0, len(texts), 1000):
        a, z = starts[low], starts[min(low + 1000, len(texts))]
        pairs = []
        for step in range(1, NEAR + 1):
            x, y, d = word[a : z - step], word[a + step : z], text_of[a : z - step]
            keep = usual[x] & usual[y] & (d == text_of[a + step : z]) & (x != y)
            # two everyday words tell nothing
            keep &= np.minimum(count[x], count[y]) * 10 <= len(texts)
            x, y, d = x[keep], y[keep], d[keep]
            pairs.append((d * vocabulary.size + np.minimum(x, y)) * vocabulary.size + np.maximum(x, y))
        seen = np.unique(np.concatenate(pairs))
        parts.append(_counted(seen % vocabulary.size**2, marked[seen // vocabulary.size**2]))
    near: set[int] = set()
    if parts:
        code, m, o = _merged(parts)
        ok = (m >= LEAST_TEXTS) & (link_ratio(m, o, all_marked, all_other) >= PAIR_RATIO)
        for c in code[ok].tolist():
            x, y = divmod(c, vocabulary.size)
            core.add(x if count[x] <= count[y] else y)
            near |= {x, y}
    # which kind the marked texts of a word mostly are
    kind_of = np.array([("abuse", "hate", "sexual").index(k) if k in ("abuse", "hate", "sexual") else 0 for k in kinds], np.int64)
    votes = np.zeros((vocabulary.size, 3), np.int64)
    owned = np.unique(text_of * vocabulary.size + word)
    owned = owned[marked[owned // vocabulary.size]]
    np.add.at(votes, (owned % vocabulary.size, kind_of[owned // vocabulary.size]), 1)
    share = votes / np.maximum(np.bincount(kind_of[marked], minlength=3), 1)
    core = {c for c in core if vocabulary[c]}
    # company: whatever stands near a core word in a few texts
    is_core = np.zeros(vocabulary.size, bool)
    is_core[list(core)] = True
    at = np.flatnonzero(is_core[word]) if word.size else np.zeros(0, np.int64)
    company = []
    for step in [*range(-NEAR, 0), *range(1, NEAR + 1)]:
        o = at + step
        o = o[(o >= 0) & (o < word.size)]
        company.append(np.unique(text_of[o] * vocabulary.size + word[o]))
    met, n = np.unique(np.unique(np.concatenate(company)) % vocabulary.size, return_counts=True)
    near |= set(met[(n >= LEAST_TEXTS) & usual[met]].tolist())
    return {str(vocabulary[c]): ("abuse", "hate", "sexual")[int(np.argmax(share[c]))] for c in sorted(core)}, [str(vocabulary[c]) for c in sorted(near - core)], vocabulary[usual].tolist()


def fit(texts: list[str], marked: np.ndarray, kinds: list[str | None]) -> Model:
    """A model with what labelled texts teach; the plain one without texts or with marks of one value only."""
    marked = np.asarray(marked, bool)
    if not len(texts) or marked.all() or not marked.any():
        return Model()
    core, company, usual_words = learned_words(texts, marked, kinds)
    model = Model(core, company, usual=usual_words)
    parts = [(low, pa.array(texts[low : low + 500], pa.string())) for low in range(0, len(texts), 500)]
    counts = []
    for low, some in parts:
        text, _, code = model.features(some)
        both = np.unique(np.stack((code, text + low)), axis=1)
        counts.append(_counted(both[0], marked[both[1]]))
    codes, m, o = _merged(counts)
    linked = (link_ratio(m, o, int(marked.sum()), int((~marked).sum())) >= np.where(codes < _SYMBOLS**2, WORD_RATIO, PAIR_RATIO)) & (m >= LEAST_TEXTS)
    codes, m, o = codes[linked], m[linked], o[linked]
    if not codes.size:
        return Model()
    first = Model(core, company, dict(zip(codes.tolist(), _surplus(m, o, float(marked.mean())).tolist(), strict=True)), usual_words)
    # what is marked for another window's sake doesn't count: the texts of a feature without sure windows elsewhere
    counts, quiet = [], np.zeros(2, np.int64)
    for low, some in parts:
        text, window, code = first.features(some)
        value, start, size = first.windows(text, window, code)
        sure = value >= 0
        least, most = np.full(len(some), 1 << 40), np.full(len(some), -1)
        np.minimum.at(least, text[start][sure], window[start][sure])
        np.maximum.at(most, text[start][sure], window[start][sure])
        quiet += np.bincount(marked[low : low + 500][most < 0].astype(int), minlength=2)
        known = np.isin(code, codes)
        order = np.lexsort((window[known], text[known], code[known]))
        t, w, c = text[known][order], window[known][order], code[known][order]
        if not t.size:
            continue
        head = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (c[1:] != c[:-1]))))
        tail = np.append(head[1:], t.size) - 1
        elsewhere = (least[t[head]] <= w[head] - WINDOW // STEP) | (most[t[head]] >= w[tail] + WINDOW // STEP)
        counts.append(_counted(c[head][~elsewhere], marked[low + t[head][~elsewhere]]))
    codes, m, o = _merged(counts)
    logit = _surplus(m, o, float(quiet[1] / max(quiet.sum(), 1)))
    kept = (m >= LEAST_TEXTS - 1) & (logit > -3)
    codes, logit = codes[kept], logit[kept]
    # only words of a kept feature stay, numbered anew
    names = dict(enumerate(model.words, len(CLASSES)))
    used = {s for c in codes.tolist() for s in ((c // _SYMBOLS) % _SYMBOLS, c % _SYMBOLS if c >= _SYMBOLS**2 else 0) if s >= len(CLASSES)}
    stay = {names[s] for s in used}
    own_core = {w: k for w, k in core.items() if w in stay}
    own_company = [w for w in company if w in stay]
    number = {w: k for k, w in enumerate(dict.fromkeys([*own_core, *own_company]), len(CLASSES))}
    learned = {}
    for c, value in zip(codes.tolist(), logit.tolist(), strict=True):
        kind, x, y = c // _SYMBOLS**2, (c // _SYMBOLS) % _SYMBOLS, c % _SYMBOLS
        x, y = (number[names[s]] if s >= len(CLASSES) else s for s in (x, y))
        learned[int(_code(kind, *(sorted((x, y)) if kind == _NEAR else (x, y))))] = value
    return Model(own_core, own_company, learned, usual_words)


def _surplus(marked: np.ndarray, other: np.ndarray, usual: float) -> np.ndarray:
    """Log odds, beyond ``SURE``, that a feature is abuse: its share of marked texts beyond the ``usual`` one."""
    sure = np.clip(((marked + usual / 2) / (marked + other + 0.5) - usual) / (1 - usual), 1e-6, 1 - 1e-6)
    return np.log(sure / (1 - sure)) - np.log(SURE / (1 - SURE))


def labelled_sample(labels: DataFrame, docs: DataFrame, doc_id: str, text: str, mark: str, kind: str, *, sample: int = SAMPLE) -> tuple[list[str], np.ndarray, list[str | None]]:
    """(texts, marks, kinds) of at most ``sample`` labelled texts, chosen by a hash of their id; of several marks the majority, none if they tie.

    The chosen ids are ``sample`` rows at most, so they are broadcast and the texts aren't shuffled.
    """
    per = labels.groupBy(F.col(doc_id).alias("_id")).agg(F.avg(mark).alias("_mark"), F.max(F.when(F.col(mark) == 1, F.col(kind))).alias("_kind")).where("_mark != 0.5")
    chosen = per.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text")).where("length(_text) > 0").join(F.broadcast(chosen), "_id").orderBy("_id", "_text").collect()
    return [r["_text"] for r in rows], np.array([r["_mark"] > 0.5 for r in rows], bool), [r["_kind"] for r in rows]


def _score(keep: int, model: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*model)
        for batch in (part for whole in batches for part in small_slices(whole, keep)):
            scores, kinds = own.score(batch.column(keep))
            arrays = [batch.column(c) for c in range(keep)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(scores), pa.array(kinds, pa.string())], names=[*batch.schema.names[:keep], "score", "kind"])

    return run


def score_abuse(df: DataFrame, keep: list[str], text: str, model: Model | None = None) -> DataFrame:
    """The ``keep`` columns of every row, with ``score`` in [0, 1) and ``kind`` (abuse, hate, sexual; null without any word of interest).

    Rows are kept whatever their text; a null or empty text scores 0. Repeated rows score alike. Whole
    texts are read, in one narrow pass without a shuffle. Other columns aren't read. Without a ``model``
    of ``fit`` the plain lexicon scores.
    """
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    rows = df.select(*keep, F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(_score(len(keep), (model or Model()).parts), f"{schema}, score double, kind string")


def rates(scored: DataFrame, by: str, threshold: float = THRESHOLD) -> DataFrame:
    """Per value of ``by`` (null is a value): texts, abusive ones and their rate."""
    hit = F.count_if(F.col("score") >= threshold)
    return scored.groupBy(by).agg(F.count("*").alias("texts"), hit.alias("abusive"), F.round(hit / F.count("*"), 6).alias("rate"))
