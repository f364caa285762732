"""Text functions that SQL lacks, as Arrow-batched functions over few rows or whole columns: snippets, stems, line
differences, languages, image headers, emoji."""

from __future__ import annotations

import re
import struct
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Accents that belong to the word when written as characters of their own: those of SQLite's unicode61.
MARKS = "".join(chr(768 + n) for n in range(50) if (0x361F808029FDF >> n) & 1)
TERM = re.compile(rf"[^\W_]+(?:[{MARKS}]+[^\W_]*)*")


@lru_cache(maxsize=100_000)
def _folded(c: str) -> str:
    if c in MARKS:
        return ""
    low = c.casefold() if len(c.casefold()) == 1 else c
    parts = unicodedata.normalize("NFD", low)
    return parts[0].lower() if len(parts) == 2 and parts[0].isascii() and parts[0].isalpha() else low


def fold(word: str) -> str:
    """Lower case without accents, as unicode61 has it: one accent on a Latin letter goes, other letters stay."""
    return word.lower() if word.isascii() else "".join(map(_folded, word))


#: Fixed values of the snippets: what the first phrase of its kind, a repeat, a sentence and the text's beginning count.
NEW_PHRASE, REPEAT, SENTENCE, BEGINNING = 1000, 1, 100, 120


def _sentences(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """Tokens that begin a sentence: the first, and those that white space after a full stop or colon precedes."""
    out = [0]
    for n, (at, _) in enumerate(spans[1:], 1):
        k = at - 1
        while text[k] in " \t\n\r":  # a token stands before
            k -= 1
        if k < at - 1 and text[k] in ".:":
            out.append(n)
    return out


def _window(found: list[tuple[int, int]], sizes: list[int], sentences: list[int], tokens: int, size: int) -> int:
    """The first token of the best window. ``found`` has (token, phrase) of each place of a phrase, ascending. A window that
    begins with a place is worth what ``value`` says and is moved so that its phrases stand in the middle; one that begins
    with the sentence of the place has a bonus and stays. The first of the best counts."""

    def within(first: int) -> list[tuple[int, int]]:
        return found[bisect_left(found, (first,)) : bisect_left(found, (first + size,))]

    def value(first: int) -> int:
        own = [p for _, p in within(first)]
        return NEW_PHRASE * len(set(own)) + REPEAT * (len(own) - len(set(own)))

    best, start = 0, 0
    for at, _ in found:
        worth = value(at)
        if worth > best:
            end = max((a, a + sizes[p]) for a, p in within(at))[1]
            # half of what is left over goes before; half of a negative number is cut towards zero
            over = size - (end - at)
            best, start = worth, max(0, min(at - (over // 2 if over >= 0 else -(-over // 2)), tokens - size))
        if tokens > size:
            sentence = sentences[bisect_right(sentences, at) - 1]
            if sentence < at:
                worth = value(sentence) + (SENTENCE if sentence else BEGINNING)
                if worth > best:
                    best, start = worth, sentence
    return start


def snippet(text: str, phrases: list[tuple[str, ...]], size: int, term: Callable[[str], str]) -> str:
    """The window of ``size`` words that SQLite's FTS5 would show for phrases of terms, phrases in brackets."""
    spans = [m.span() for m in TERM.finditer(text)]
    terms = [term(text[a:z]) for a, z in spans]
    if not spans:
        return text
    found = sorted((n, p) for p, words in enumerate(phrases) for n, t in enumerate(terms) if t == words[0] and tuple(terms[n : n + len(words)]) == words)
    first = _window(found, [len(p) for p in phrases], _sentences(text, spans) if len(spans) > size else [0], len(spans), size)
    end = min(len(spans), first + size)
    marked: list[list[int]] = []  # first and end token of phrases, those that overlap as one
    for at, p in found:
        if marked and at < marked[-1][1]:
            marked[-1][1] = max(marked[-1][1], at + len(phrases[p]))
        else:
            marked.append([at, at + len(phrases[p])])
    out, at = ["…" if first else ""], spans[first][0] if first else 0
    for a, z in marked:
        if first <= a < end:
            start, stop = spans[a][0], spans[min(z, end) - 1][1]
            out += [text[at:start], "[", text[start:stop], "]"]
            at = stop
    rest = text[at:] if end == len(spans) else text[at : spans[end - 1][1]] + "…"
    return "".join([*out, rest])


def snippet_of(phrases: list[tuple[str, ...]], size: int = 20, term: Callable[[str], str] = fold):
    """The stretch of at most ``size`` words that shows the phrases best, phrases in brackets; words are the same if their
    ``term`` is. A null text has an empty one. Apply it after the limit."""
    wanted = [tuple(term(w) for w in p) for p in phrases]

    @F.pandas_udf(T.StringType())
    def cut(text: pd.Series) -> pd.Series:
        return text.map(lambda t: snippet(t or "", wanted, size, term))

    return cut


def _furthest(a: list[int], b: list[int]) -> tuple[int, int, int, int]:
    """The stretch of equal lines in the middle of a shortest edit of a into b: where it starts and ends in both. Paths are
    grown from both ends, edit by edit, until two meet (E. W. Myers, 1986); the memory is that of two rows."""
    n, m = len(a), len(b)
    odd, most = (n - m) % 2, (n + m + 1) // 2
    on, back = {1: 0}, {1: 0}
    for d in range(most + 1):
        for k in range(-d, d + 1, 2):
            x = on[k + 1] if k == -d or (k != d and on.get(k - 1, -1) < on.get(k + 1, -1)) else on[k - 1] + 1
            y = start = x - k
            while x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            on[k] = x
            other = n - m - k
            if odd and -d < other < d and x + back.get(other, -1) >= n:
                return x - (y - start), start, x, y
        for k in range(-d, d + 1, 2):
            x = back[k + 1] if k == -d or (k != d and back.get(k - 1, -1) < back.get(k + 1, -1)) else back[k - 1] + 1
            y = start = x - k
            while x < n and y < m and a[n - 1 - x] == b[m - 1 - y]:
                x, y = x + 1, y + 1
            back[k] = x
            other = n - m - k
            if not odd and -d <= other <= d and x + on.get(other, -1) >= n:
                return n - x, m - y, n - x + (y - start), m - start
    raise AssertionError("two paths meet")


def common_lines(old: list[str], new: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of the lines, ascending. Lines that one side alone has can't be in it and go first;
    the time grows with the lines left times their differences."""
    numbers: dict[str, int] = {}
    a, b = ([numbers.setdefault(x, len(numbers)) for x in lines] for lines in (old, new))
    both = set(a) & set(b)
    at_a, at_b = ([n for n, x in enumerate(lines) if x in both] for lines in (a, b))
    a, b = [a[n] for n in at_a], [b[n] for n in at_b]
    out, left = [], [(0, len(a), 0, len(b))]
    while left:
        a0, a1, b0, b1 = left.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((at_a[a0], at_b[b0]))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((at_a[a1], at_b[b1]))
        if a0 < a1 and b0 < b1:
            x0, y0, x1, y1 = _furthest(a[a0:a1], b[b0:b1])
            out += [(at_a[a0 + x0 + n], at_b[b0 + y0 + n]) for n in range(x1 - x0)]
            left += [(a0, a0 + x0, b0, b0 + y0), (a0 + x1, a1, b0 + y1, b1)]
    return sorted(out)


def line_changes(old: str, new: str) -> list[tuple[int | None, str, str]]:
    """(position in the new text, Unchanged, Inserted or Deleted, line) in reading order, as few changes as there can be; where lines
    are replaced the old ones come first."""
    a, b = old.split("\n"), new.split("\n")
    out: list[tuple[int | None, str, str]] = []
    i = j = 0
    for x, y in [*common_lines(a, b), (len(a), len(b))]:
        out += [(None, "Deleted", line) for line in a[i:x]]
        out += [(n + 1, "Inserted", b[n]) for n in range(j, y)]
        if x < len(a):
            out.append((y + 1, "Unchanged", b[y]))
        i, j = x + 1, y + 1
    return out


@F.pandas_udf(T.ArrayType(T.StructType().add("position", T.IntegerType()).add("change", T.StringType()).add("line", T.StringType())))
def line_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([[{"position": p, "change": c, "line": x} for p, c, x in line_changes(o or "", n or "")] for o, n in zip(old, new, strict=True)])


def image_info(raw: bytes) -> tuple[int, int, str, bool] | None:
    """(width, height, format, may be transparent) from the header of a PNG, GIF, JPEG or WebP; None otherwise."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n" and len(raw) >= 26:
        w, h = struct.unpack(">II", raw[16:24])
        return w, h, "PNG", raw[25] in (4, 6) or b"tRNS" in raw[:4096]
    if raw[:6] in (b"GIF87a", b"GIF89a") and len(raw) >= 10:
        w, h = struct.unpack("<HH", raw[6:10])
        at = raw.find(b"\x21\xf9\x04")
        return w, h, "GIF", at >= 0 and len(raw) > at + 3 and bool(raw[at + 3] & 1)
    if raw[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(raw) and raw[at] == 0xFF:
            kind, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", raw[at + 5 : at + 9])
                return w, h, "JPEG", False
            at += 2 + size
    if raw[:4] == b"RIFF" and raw[8:16] == b"WEBPVP8X" and len(raw) >= 30:
        return int.from_bytes(raw[24:27], "little") + 1, int.from_bytes(raw[27:30], "little") + 1, "WEBP", bool(raw[20] & 16)
    return None


@F.pandas_udf(T.StructType().add("width", T.IntegerType()).add("height", T.IntegerType()).add("image_type", T.StringType()).add("is_transparent", T.BooleanType()))
def image_header(body: pd.Series) -> pd.DataFrame:
    rows = [image_info(bytes(b)) if b is not None else None for b in body]
    return pd.DataFrame([r or (None, None, None, None) for r in rows], columns=["width", "height", "image_type", "is_transparent"]).astype({"width": "Int32", "height": "Int32"})


#: The characters that Unicode (15) calls extended pictographic, in ranges.
PICTOGRAPHIC = (
    "©®‼⁉™ℹ↔-↙↩-↪⌚-⌛⌨⎈⏏⏩-⏳⏸-⏺Ⓜ▪-▫▶◀◻-◾☀-★☇-☒☔-⚅⚐-✅"
    "✈-✒✔✖✝✡✨✳-✴❄❇❌❎❓-❕❗❣-❧➕-➗➡➰➿⤴-⤵⬅-⬇⬛-⬜⭐⭕〰〽㊗㊙"
    "\U0001f000-\U0001f0ff\U0001f10d-\U0001f10f\U0001f12f\U0001f16c-\U0001f171\U0001f17e-\U0001f17f\U0001f18e\U0001f191-\U0001f19a\U0001f1ad-\U0001f1e5\U0001f201-\U0001f20f\U0001f21a\U0001f22f\U0001f232-\U0001f23a\U0001f23c-\U0001f23f"
    "\U0001f249-\U0001f3fa\U0001f400-\U0001f53d\U0001f546-\U0001f64f\U0001f680-\U0001f6ff\U0001f774-\U0001f77f\U0001f7d5-\U0001f7ff\U0001f80c-\U0001f80f\U0001f848-\U0001f84f\U0001f85a-\U0001f85f\U0001f888-\U0001f88f\U0001f8ae-\U0001f8ff"
    "\U0001f90c-\U0001f93a\U0001f93c-\U0001f945\U0001f947-\U0001faff\U0001fc00-\U0001fffd"
)
_EMOJI = rf"^(?:[{PICTOGRAPHIC}]|[\x{{1f1e6}}-\x{{1f1ff}}]|[0-9#*]\x{{fe0f}}?\x{{20e3}})"


def is_one_emoji(text: Column) -> Column:
    """Whether the text is a single emoji as readers see it: joined sequences, flags, keycaps and skin tones count as one. A null
    text isn't one."""
    return F.coalesce(text.rlike(r"^\X\z") & text.rlike(_EMOJI), F.lit(False))


#: A sentence or more and the frequent words of the 14 languages, from which their profiles are made.
LANGUAGE_SAMPLES = {
    "en": "all human beings are born free and equal in dignity and rights they are endowed with reason and conscience and should act towards one another in a spirit of brotherhood everyone has the right to life liberty and security of person no one shall be held in slavery the of and to in is that for it as was with be by on not he his but at this have from or had an which you were her she there would their we him been has when who will more if out so what about up into than them can only other time some could these two may then do first any my now such like our over me even most made after also did many before must through years where much your way well down because each just those people how too good",
    "de": "alle menschen sind frei und gleich an würde und rechten geboren sie sind mit vernunft und gewissen begabt und sollen einander im geist der brüderlichkeit begegnen jeder hat das recht auf leben freiheit und sicherheit der person niemand darf in sklaverei gehalten werden der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er hat dass sie nach wird bei einer um am noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn können ihre seine wir ich unter kann gegen vom schon hatte sehr diese dieser zwischen immer wieder heute jahr zeit weil müssen andere",
    "fr": "tous les êtres humains naissent libres et égaux en dignité et en droits ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité tout individu a droit à la vie à la liberté et à la sûreté de sa personne nul ne sera tenu en esclavage de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec mais ou son lui nous comme aux cette si leur même ses entre deux elle tout être fait était été ont cela aussi bien peut encore sans où ces après avait vous je depuis temps toujours très faire autre années quelques beaucoup",
    "es": "todos los seres humanos nacen libres e iguales en dignidad y derechos y dotados como están de razón y conciencia deben comportarse fraternalmente los unos con los otros todo individuo tiene derecho a la vida a la libertad y a la seguridad de su persona nadie estará sometido a esclavitud de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así nos ni parte tiene él uno donde bien tiempo mismo ese ahora cada vida otro después",
    "it": "tutti gli esseri umani nascono liberi ed eguali in dignità e diritti essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza ogni individuo ha diritto alla vita alla libertà ed alla sicurezza della propria persona nessuno potrà essere tenuto in schiavitù di e il la che in un a per è una non sono con si da come le dei nel alla più della ha lo del i anche gli ma delle al se ci questo o mi suo due dalla nella tra quando era degli essere sua dal prima stato dove molto anni perché fatto ancora tutto già così solo loro può dopo questa quella cosa sempre senza tempo",
    "pt": "todos os seres humanos nascem livres e iguais em dignidade e em direitos dotados de razão e de consciência devem agir uns para com os outros em espírito de fraternidade todo o indivíduo tem direito à vida à liberdade e à segurança pessoal ninguém será mantido em escravatura de a o que e do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua ou quando muito nos já eu também só pelo pela até isso ela entre depois sem mesmo aos seus quem nas me esse eles você essa num nem suas meu às minha têm numa foi são está há então anos tempo ainda onde fazer coisa outro nós assim",
    "nl": "alle mensen worden vrij en gelijk in waardigheid en rechten geboren zij zijn begiftigd met verstand en geweten en behoren zich jegens elkander in een geest van broederschap te gedragen een ieder heeft recht op leven vrijheid en onschendbaarheid van zijn persoon niemand zal in slavernij gehouden worden de van het een en in is dat op te zijn met voor niet die aan er om ook als dan maar bij nog uit door over ze naar heeft hij ik je was worden wordt kan meer al geen wel tot hebben deze moet zou werd veel haar hun jaar zo wat waar onder tegen na zich mijn onze alleen mensen tijd twee goed andere altijd omdat hier toen",
    "sv": "alla människor är födda fria och lika i värde och rättigheter de är utrustade med förnuft och samvete och bör handla gentemot varandra i en anda av broderskap var och en har rätt till liv frihet och personlig säkerhet ingen får hållas i slaveri och i att det som en på är av för med den till inte har de om ett han men var jag sig från vi så kan när år under också efter eller nu sin där vid mot ska skulle kommer ut får finns vara hade alla andra mycket än här då sedan över bara blir upp även vad få två vill många hon någon sitt bli utan mellan själv varje tid hur måste alltid gå bra",
    "da": "alle mennesker er født frie og lige i værdighed og rettigheder de er udstyret med fornuft og samvittighed og de bør handle mod hverandre i en broderskabets ånd enhver har ret til liv frihed og personlig sikkerhed ingen må holdes i slaveri og i at det er en til af på for med den som de der ikke et har om jeg han men var sig fra vi så kan når år under også efter eller nu sin hvor ved mod skal skulle kommer ud får vil være havde alle andre meget end her da over kun bliver op hvad to mange hun nogle sit blive uden mellem selv hver tid hvordan må altid gå godt blev hvis mig dig noget nogen efter af af uge fordi kunne ville",
    "no": "alle mennesker er født frie og med samme menneskeverd og menneskerettigheter de er utstyrt med fornuft og samvittighet og bør handle mot hverandre i brorskapets ånd enhver har rett til liv frihet og personlig sikkerhet ingen må holdes i slaveri og i det er på som en til å av for med at den har de ikke et om jeg han men var seg fra vi så kan når år under også etter eller nå sin hvor ved mot skal skulle kommer ut får vil være hadde alle andre mye enn her da over bare blir opp hva to mange hun noen sitt bli uten mellom selv hver tid hvordan må alltid gå godt ble hvis meg deg noe uke fordi kunne ville fram gjennom etter av av dag",
    "ru": "все люди рождаются свободными и равными в своём достоинстве и правах они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства каждый человек имеет право на жизнь на свободу и на личную неприкосновенность никто не должен содержаться в рабстве и в не на я быть он с что а по это она этот к но они мы весь который из у то за свой её так от же для вы о год человек только себя один как ещё бы такой когда другой сказать время если самый",
    "ja": "すべての人間は生まれながらにして自由でありかつ尊厳と権利とについて平等である人間は理性と良心とを授けられており互いに同胞の精神をもって行動しなければならないこれはそれがあるからですますしたことものためよりとしていない何人も",
    "ko": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다 모든 사람은 생명과 신체의 자유와 안전에 대한 권리를 가진다 이 그 저 것은 있다 없다 하는 에서 으로 했다 그리고 하지만",
    "zh": "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待人人有权享有生命自由和人身安全任何人不得使为奴隶或奴役的一是不了在有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年過發後說這個們來時會對國學",
}
#: Ranks of a profile that count; han and kana characters are words by themselves.
RANKS = 400
_LETTERS = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]|[^\W\d_\u3040-\u30ff\u3400-\u9fff]+")


def _ranked(text: str) -> np.ndarray:
    """The most frequent n-grams of 1 to 4 characters, words padded, as numbers, most frequent first."""
    said = f" {' '.join(_LETTERS.findall(unicodedata.normalize('NFC', text).lower()))} "
    c = np.frombuffer(said.encode("utf-32-le"), np.uint32).astype(np.uint64)
    inner = c != 32
    two = c[:-1] << np.uint64(21) | c[1:]
    three = two[:-1] << np.uint64(21) | c[2:]
    four = (three[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[3:]) | np.uint64(1 << 63)
    # a space is at an n-gram's ends only
    grams = np.concatenate([c[inner], two if inner.any() else two[:0], three[inner[1:-1]], four[inner[1:-2] & inner[2:-1]]])
    found, count = np.unique(grams, return_counts=True)
    return found[np.lexsort((found, -count))[:RANKS]]


@lru_cache(maxsize=1)
def _profiles() -> tuple[list[str], np.ndarray, np.ndarray]:
    """The languages, all n-grams of their profiles ascending, and for each language their ranks (-1: not in it)."""
    own = {lang: _ranked(sample) for lang, sample in sorted(LANGUAGE_SAMPLES.items())}
    known = np.unique(np.concatenate(list(own.values())))
    ranks = np.full((len(own), len(known)), -1)
    for n, grams in enumerate(own.values()):
        ranks[n, np.searchsorted(known, grams)] = np.arange(len(grams))
    return list(own), known, ranks


def language_of(text: str | None, least: int = 150, most: int = 4096) -> str | None:
    """The language of 14 whose n-gram ranks are nearest; None for short texts and those without a letter."""
    if not text or len(text) < least:
        return None
    own = _ranked(text[:most])
    if not len(own):
        return None
    languages, known, ranks = _profiles()
    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
    mine = np.where(known[at] == own, ranks[:, at], -1)
    away = np.where(mine >= 0, np.abs(mine - np.arange(len(own))), RANKS).sum(1)
    best = int(away.argmin())
    return languages[best] if away[best] < RANKS * len(own) else None


@F.pandas_udf(T.StringType())
def detected_language(text: pd.Series) -> pd.Series:
    return text.map(language_of)
