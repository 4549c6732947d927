"""Personal data: detection and surrogates.

Entities (e-mail addresses, phone and card numbers, social-security numbers, IPv4 addresses, and names) receive replacements derived from a secret key and the entity alone, so a mention gets the same one in every document
without any state: coreference across the corpus. A mention's form is kept: a number keeps its length, signs and country
code, a card its Luhn validity, an address its class, a local part its letters' script and case, a name the gender of its
title, its script and its number of words; a surname maps alone, so 'Mrs Ada Byron' and 'Mrs Byron' stay one person.
Given names and surname make a person, whose gender is that of the titles it has anywhere in the corpus: 'Dr Ada Byron' is
the same person, unless the corpus has both genders or none for the name, where the key decides.
A name is told by a title before it. Once one is told, the same text's other mentions of that full name, or of the surname
alone, are replaced too: 'Ada Byron' and 'Byron' after 'Mrs Ada Byron'. Particles ('von', 'de la') and the O' of O'Brien
stay as they are.

Distinctness: the distinct entities of the corpus are given their surrogates, and where two share one, or one is itself an
entity of the corpus, all but the first in order draw again, until none does. Surnames are told apart first, and given
names within a surname by draws of their own. The space grows with the draw, by syllables,
letters or digits, so this ends for any number of entities; only what draws again often loses the length or class of its
form. Those that drew again are exceptions; they are broadcast up to EXCEPTIONS rows and joined by document beyond that.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize, release
from .common import has_columns, in_arrow

KINDS = ("email", "phone", "ssn", "card", "ip", "name")
EXCEPTIONS = 50_000
#: Names and local parts grow by one step every GROW draws, numbers and addresses, whose form tells more, every GROW_FORM.
GROW, GROW_FORM = 2, 8
_EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]*\w@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}")
_NUMBER = re.compile(
    r"(?P<phone>(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){1,4}(?!\w)|(?<![\w(])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?!\w)|(?<![\w.-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![\w-])"
    r"|(?<![\w./-])0[1-9](?:[0-9]{1,3}/|[0-9]{0,3}[ -])[0-9]{3,4}[ -]?[0-9]{3,4}(?![\w-])|(?<![\w./-])0[1-9](?: [0-9]{2}){4}(?![\w-]))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?!\w))"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\w|\.[0-9]))"
)
_DIGIT = re.compile("[0-9]")
_TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "г-жа", "Г-жа", "κυρία", "Κυρία", "السيدة"),
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Signor", "г-н", "Г-н", "κύριος", "Κύριος", "السيد"),
    "": ("Dr", "Prof"),
}
_GENDER = {t: g for g, titles in _TITLES.items() for t in titles}
PARTICLES_BEFORE = 4
PARTICLES = frozenset("von van der den de del della di da dos das du la le bin ibn al el ter zu zum zur af av".split())
_CAPITAL = r"\p{Lu}(?:['’]\p{Lu})?\p{L}+"
_WITH = rf"(?:(?:{'|'.join(sorted(PARTICLES))})[ \xa0])*{_CAPITAL}"
#: Scripts without capitals have no end of a name but a number of letters or words.
_NAME = regex.compile(
    rf"(?<!\w)(?P<title>{'|'.join(sorted(_GENDER, key=len, reverse=True))})\.?[ \xa0]"
    rf"(?P<name>{_WITH}(?:[ \xa0-]{_WITH}){{0,2}}|\p{{Han}}{{2,3}}|\p{{Arabic}}{{2,}}(?:[ \xa0]\p{{Arabic}}{{2,}})?)"
)
_TOKEN = regex.compile(r"\p{L}(?:['’]\p{Lu})?\p{L}*")
_FIRST = {
    ("LATIN", "f"): "Alma Berta Clara Dora Edna Flora Greta Hilda Irma Julia Klara Lydia Marta Nora Olga Paula Rita Sara Thea Vera".split(),
    ("LATIN", "m"): "Arno Bruno Carl Dirk Egon Felix Georg Hugo Ivan Jonas Kurt Lars Max Nils Otto Paul Rolf Sven Theo Viktor".split(),
    ("CYRILLIC", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Лидия Нина".split(),
    ("CYRILLIC", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Олег".split(),
    ("GREEK", "f"): "Άννα Βασιλική Δάφνη Ελένη Ζωή Ειρήνη Κατερίνα Μαρία".split(),
    ("GREEK", "m"): "Άρης Βασίλης Γιώργος Δήμος Ηλίας Κώστας Νίκος Πέτρος".split(),
    ("ARABIC", "f"): "أمل بدرية ثريا جميلة حنان خديجة دلال رانيا".split(),
    ("ARABIC", "m"): "أحمد باسم جمال حسن خالد داود رامي سامي".split(),
    ("HAN", "f"): list("芳娟敏静丽燕玲梅"),
    ("HAN", "m"): list("伟强磊军勇杰涛刚"),
}
_SYLLABLES = {
    "LATIN": "ba be bi bo da de di do fa fe ga ge ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se ta te ti to va ve".split(),
    "CYRILLIC": "ба бе би бо да де ди до га ге ка ки ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се та те ти то ва ве".split(),
    "GREEK": "βα βε βι βο δα δε δι γα γε κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο ρα ρε ρι ρο σα σε τα τε τι το".split(),
    "ARABIC": "با بي بو دا دي دو كا كي كو لا لي لو ما مي مو نا ني نو را ري رو سا سي سو تا تي تو فا في فو".split(),
    "HAN": list("安白常程邓丁范方冯傅高葛顾郭韩郝何贺洪胡黄江姜孔雷黎李林刘卢罗马孟潘彭钱秦任邵沈石宋苏孙谭唐田汪王韦魏吴武夏"),
}
_ENDING = {"LATIN": "nson", "CYRILLIC": "нко", "GREEK": "κης", "ARABIC": "اوي", "HAN": ""}

Mention = tuple[int, int, str, str]


def script(text: str) -> str:
    """LATIN, CYRILLIC, GREEK, ARABIC or HAN by the first letter that is one of them; LATIN otherwise."""
    for ch in text:
        name = unicodedata.name(ch, "").split(" ")[0]
        name = "HAN" if name == "CJK" else name
        if name in _SYLLABLES:
            return name
    return "LATIN"


def mentions(text: str) -> list[Mention]:
    """(start, end, kind, mention) of entities, in order and without overlap. Of those that begin together the order is that
    of KINDS; names without a title give way to all others."""
    found: list[Mention] = []
    if "@" in text:
        found += [(*m.span(), "email", m[0]) for m in _EMAIL.finditer(text)]
    if _DIGIT.search(text):
        found += [(*m.span(), m.lastgroup, m[0]) for m in _NUMBER.finditer(text)]
    if any(t in text for t in _GENDER):
        named = [(*m.span("name"), "name:" + _GENDER[m["title"]], m["name"]) for m in _NAME.finditer(text)]
        if named:
            return _apart(_apart(found + named), _untitled(text, named))
    return _apart(found) if len(found) > 1 else found


def _apart(found: list[Mention], more: Iterable[Mention] = ()) -> list[Mention]:
    """The mentions that don't begin inside one that is taken before them; then those of `more` that touch none of these."""
    rank = {k: i for i, k in enumerate(KINDS)}
    taken: list[Mention] = []
    for m in sorted(found, key=lambda m: (m[0], rank[m[2].split(":")[0]])):
        if not taken or m[0] >= taken[-1][1]:
            taken.append(m)
    starts, added = [m[0] for m in taken], []
    for m in sorted(more):
        k = bisect_left(starts, m[1])
        if (k == 0 or taken[k - 1][1] <= m[0]) and (not added or added[-1][1] <= m[0]):
            added.append(m)
    return sorted(taken + added) if added else taken


def _in_word(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


def _fold(word: str) -> str:
    """A part of a name without case and kind of apostrophe."""
    return word.casefold().replace("’", "'")


def _untitled(text: str, named: list[Mention]) -> Iterator[Mention]:
    """Mentions without a title, or again, of the full names and surnames that `named` has, the longest at each surname."""
    full = {_person(name) for *_, name in named}
    surnames = {_fold(_split(name)[-1]) for *_, name in named}
    reach = max(len(x.split(" ")) for x in full) - 1 + PARTICLES_BEFORE
    for name in {name for *_, name in named if script(name) == "HAN"}:  # words aren't told apart there
        at = text.find(name)
        while at >= 0:
            yield at, at + len(name), "name:", name
            at = text.find(name, at + len(name))
    before: list[int] = []  # starts of the last words
    for m in _TOKEN.finditer(text):
        if _fold(m[0]) in surnames and not m[0].islower() and script(m[0]) != "HAN":
            end = m.end()
            start = next((s for s in before if _person(text[s:end]) in full), m.start())
            if not (_in_word(text[end : end + 1]) or start and (_in_word(text[start - 1]) or text[start - 1] in "@.")):
                yield start, end, "name:", text[start:end]
        before = [*before, m.start()][-reach:]


def canonical(kind: str, mention: str) -> str:
    """What mentions of one entity share: lower-case address, digits of a number, a name without case."""
    if kind in ("phone", "ssn", "card"):
        return "".join(c for c in mention if "0" <= c <= "9")
    return mention.casefold()


class Stream:
    """Keyed pseudo-random choices for one entity and draw."""

    def __init__(self, key: bytes, kind: str, entity: str, draw: int):
        self.seed, self.n, self.pool = hmac.new(key, f"{kind}\x00{entity}\x00{draw}".encode("utf-8", "surrogatepass"), hashlib.sha256).digest(), 0, 0

    def below(self, n: int) -> int:
        if self.pool < n << 64:
            self.n += 1
            self.pool = int.from_bytes(hashlib.sha256(self.seed + self.n.to_bytes(4, "big")).digest(), "big")
        self.pool, x = divmod(self.pool, n)
        return x


def _luhn(digits: str) -> int:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _digits(old: str, s: Stream, keep: int = 0) -> str:
    """As many digits, the first `keep` of them kept; the first replaced one is 0 only where it was."""
    out = old[:keep]
    for k, c in enumerate(old[keep:]):
        out += str(s.below(10)) if k or c == "0" else str(1 + s.below(9))
    return out


def _shape(old: str, s: Stream) -> str:
    """Letters for letters of the same script and case, digits for digits, all else kept."""
    out = []
    for ch in old:
        if "0" <= ch <= "9":
            out.append(str(s.below(10)))
        elif ch.isalpha():
            kind = script(ch)
            letters = "".join(dict.fromkeys("".join(_SYLLABLES[kind])))
            new = letters[s.below(len(letters))]
            out.append(new.upper() if ch.isupper() else new)
        else:
            out.append(ch)
    return "".join(out)


def _surname(old: str, key: bytes, draw: int) -> str:
    s, kind = Stream(key, "surname", _fold(old), draw), script(old)
    syllables = _SYLLABLES[kind]
    new = "".join(syllables[s.below(len(syllables))] for _ in range(3 + draw // GROW)).capitalize() + _ENDING[kind]
    return old[:2] + new if old[1:2] in ("'", "’") else new


def _split(name: str) -> list[str]:
    """Given names and surname; particles are no part of either."""
    return [w for w in re.split(r"[ \xa0-]", name) if w not in PARTICLES]


def _person(name: str) -> str:
    """Given names and surname without case, whatever stands between them."""
    return _fold(" ".join(_split(name)))


def _guess(person: str, key: bytes) -> str:
    """The gender of a person of whom no title tells it."""
    return "fm"[Stream(key, "gender", person.split(" ")[0], 0).below(2)]


def _given(old: str, gender: str, key: bytes, draw: int) -> str:
    s, kind = Stream(key, "first", _fold(old), draw), script(old)
    pool, syllables = _FIRST[kind, gender], _SYLLABLES[kind]
    return pool[s.below(len(pool))] + "".join(syllables[s.below(len(syllables))] for _ in range(draw // GROW))


def _cased(new: str, old: str) -> str:
    return new.upper() if old.isupper() and len(old) > 1 else new


def surrogate(kind: str, mention: str, key: bytes, draw: int = 0, given: int = 0) -> str:
    """The replacement of a mention, in its form; `given` is the draw of a person's given names."""
    kind, _, gender = kind.partition(":")
    entity = canonical(kind, mention)
    s = Stream(key, kind, entity, draw)
    if kind == "email":
        local, _, domain = mention.rpartition("@")
        host, _, tld = domain.rpartition(".")
        base = _shape(local.casefold(), s)
        longer = _shape("a0" * (draw // GROW), s)
        place = _shape(host.casefold(), Stream(key, "domain", host.casefold(), 0))
        return f"{''.join(b.upper() if a.isupper() else b for a, b in zip(local, base)) if len(base) == len(local) else base}{longer}@{place}.{tld}"
    if kind == "ip":
        a = [int(x) for x in mention.split(".")]
        head = 1 if a[0] in (10, 127) else 2 if a[:2] == [192, 168] else 0
        new = a[:head] + [1 + s.below(254) if k == 3 else s.below(256) for k in range(head, 4)]
        if not head:
            new[0] = [x for x in range(11, 224) if x not in (127, 172, 192)][s.below(210)]
        if draw >= GROW_FORM and head == 2:  # another private network, then reserved addresses, then more parts than an address has
            new = [10, *(s.below(256) for _ in range(3))]
        if draw >= 2 * GROW_FORM:
            new = [240 + s.below(15), *(s.below(256) for _ in range(1 + draw // GROW_FORM))]
        return ".".join(map(str, new))
    if kind == "name":
        words = re.split(r"([  -])", mention)
        kept, n = [], len(words)
        for k, w in enumerate(words):
            if k % 2:
                kept.append(w)
            elif w in PARTICLES:
                kept.append(w)
            elif k == n - 1:
                kept.append(_cased(_surname(w, key, draw), w))
            else:
                kept.append(_cased(_given(w, gender or _guess(_person(mention), key), key, given), w))
        return "".join(kept)
    keep = 0
    if kind == "phone" and mention.startswith("+"):
        keep = len(re.match(r"\+([0-9]{1,3}?)(?![0-9])|\+([0-9])", mention)[0]) - 1
    elif kind == "phone" and mention.startswith("0"):
        keep = 1
    longer = "0" * (draw // GROW_FORM)
    if kind == "card":
        new = _digits(entity[:-1] + longer, s)
        valid = _luhn(entity) == 0
        check = (10 - _luhn(new + "0")) % 10
        new += str(check if valid else (check + 1 + s.below(9)) % 10)
    else:
        new = _digits(entity + longer, s, keep)
    fill = iter(new)
    return "".join(next(fill) if "0" <= c <= "9" else c for c in mention) + "".join(fill)


def _parts(kind: str, mention: str) -> list[tuple[str, str]]:
    """The units whose surrogates must be distinct: of names the surname, and the person if there is a given name, as gender
    of the title ("-" without), colon, person."""
    if not kind.startswith("name"):
        return [(kind, canonical(kind, mention))]
    words = _split(mention)
    surname = [("surname", _fold(words[-1]))]
    return surname if len(words) == 1 else [*surname, ("given", f"{kind.partition(':')[2] or '-'}:{_person(mention)}")]


def _keys(kind: str, mention: str) -> list[tuple[str, str]]:
    """The exceptions that a mention's surrogate may depend on."""
    parts = _parts(kind, mention)
    if parts[-1][1].startswith("-:") and parts[-1][0] == "given":
        person = parts.pop()[1][2:]
        parts += [("gender", person), ("given", f"f:{person}"), ("given", f"m:{person}")]
    return parts


def _replaced(kind: str, mention: str, key: bytes, draws: dict[tuple[str, str], int]) -> str:
    part, *rest = _parts(kind, mention)
    if not rest:
        return surrogate(kind, mention, key, draws.get(part, 0))
    gender, person = rest[0][1][0], rest[0][1][2:]
    if gender == "-":
        known = draws.get(("gender", person))
        gender = _guess(person, key) if known is None else "fm"[known]
    return surrogate(f"name:{gender}", mention, key, draws.get(part, 0), draws.get(("given", f"{gender}:{person}"), 0))


def replace(text: str, key: bytes, draws: dict[tuple[str, str], int]) -> tuple[str, list[Mention]]:
    out, at, found = [], 0, mentions(text)
    for a, b, kind, mention in found:
        out += [text[at:a], _replaced(kind, mention, key, draws)]
        at = b
    return "".join([*out, text[at:]]) if found else text, found


def _sliced(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _entities(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct entities of each batch, with one mention to draw for."""
    for batch in _sliced(batches):
        seen = {}
        for text in batch.column(0):
            for _, _, kind, mention in mentions(text.as_py() or ""):
                for e in _parts(kind, mention):
                    if e[0] in ("surname", "given"):
                        seen[e] = e[1]
                    elif e not in seen or mention < seen[e]:
                        seen[e] = mention
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[k] for x in rows], pa.string()) for rows in [[(*e, m) for e, m in seen.items()]] for k in range(3)],
            names=["kind", "entity", "mention"]
        )


def _new(kind: str, entity: str, mention: str, key: bytes, draw: int) -> str:
    """What the surrogate of an entity is compared by: of a person the new given names beside the old surname."""
    if kind == "surname":
        return _surname(entity, key, draw).casefold()
    if kind == "given":
        *given, surname = entity[2:].split(" ")
        return " ".join([*(_given(w, entity[0], key, draw).casefold() for w in given), surname])
    return canonical(kind, surrogate(kind, mention, key, draw))


def _draw(key: bytes):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [_new(kind, entity, mention, key, draw) for kind, entity, mention, draw in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=[*batch.schema.names, "surrogate"])

    return run


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, draw) of entities (kind, entity, mention) whose first surrogate collided, with the draw that doesn't.

    A collision is a surrogate that another entity of the kind has or is. The entity that comes first of those that share
    one keeps it, and what is settled stays so. Rounds go on until there is none; a round writes only what it draws anew.
    """
    spark = entities.sparkSession
    shape = "kind string, entity string, mention string, draw int, surrogate string"
    real = entities.select("kind", F.col("entity").alias("surrogate"))
    settled: list[DataFrame] = []
    again = entities.withColumn("draw", F.lit(0))
    while True:
        drawn = again.transform(in_arrow(_draw(key), shape))
        first = F.min("entity").over(Window.partitionBy("kind", "surrogate"))  # each draw shares its space by chance alone
        taken = reduce(DataFrame.unionByName, [t.filter("not bad").select("kind", "surrogate") for t in settled], real).withColumn("taken", F.lit(True))
        checked = drawn.withColumn("first", first).join(taken.distinct(), ["kind", "surrogate"], "left")
        bad = (F.col("entity") != F.col("first")) | F.coalesce("taken", F.lit(False))
        marked = materialize(checked.select("kind", "entity", "mention", "draw", "surrogate", bad.alias("bad")), "surrogates")
        settled.append(marked)
        if marked.filter("bad").isEmpty():
            break
        again = marked.filter("bad").select("kind", "entity", "mention", (F.col("draw") + 1).alias("draw"))
    none = spark.createDataFrame([], "kind string, entity string, draw int")
    again = reduce(DataFrame.unionByName, [t.filter("not bad").select("kind", "entity", "draw") for t in settled[1:]], none)
    kept = materialize(again, "draws")
    for t in settled:
        release(spark, t)
    return kept


def _persons(key: bytes):
    """Of persons and the genders of their titles: the entities `given`, and as `gender` what differs from the key's guess."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for person, genders in zip(*(c.to_pylist() for c in batch.columns)):
                known, guess = [g for g in "fm" if g in genders], _guess(person, key)
                untold = known[0] if len(known) == 1 else guess
                if "-" in genders and untold != guess:
                    rows.append(("gender", person, person, "fm".index(untold)))
                rows += [("given", f"{g}:{person}", f"{g}:{person}", 0) for g in sorted({*known, *([untold] if "-" in genders else [])})]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int32()))],
                names=["kind", "entity", "mention", "draw"]
            )

    return run


def _replacer(key: bytes, draws: Callable[[], dict] | None):
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = draws() if draws else None
        for batch in _sliced(batches):
            own = batch.column(2).to_pylist() if known is None else None
            texts, spans = [], []
            for k, text in enumerate(batch.column(1)):
                text = text.as_py()
                if text is None:
                    texts.append(None)
                    spans.append([])
                    continue
                use = known if known is not None else {(d["kind"], d["entity"]): d["draw"] for d in own[k] or ()}
                new, found = replace(text, key, use)
                texts.append(new)
                spans.append([{"kind": kind.split(":")[0], "start": a, "end": b} for a, b, kind, _ in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(spans, spans_type)], names=["id", "text", "spans"])

    return run


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", exceptions_limit: int = EXCEPTIONS) -> DataFrame:
    """One row per row of docs: <id_col>, <text_col> with surrogates, spans array of (kind, start, end) in the old text.

    Null texts stay null. Texts without an entity are unchanged. Rows that repeat are each replaced, alike. Other columns
    are not read. The key decides all surrogates; without it they can't be traced back.
    """
    has_columns(docs, (id_col, text_col))
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    entities = src.select("text").transform(in_arrow(_entities, "kind string, entity string, mention string")).groupBy("kind", "entity").agg(F.min("mention").alias("mention"))
    entities = materialize(entities, "entities")
    named = entities.filter("kind = 'given'").select(F.expr("substring(entity, 3)").alias("person"), F.expr("substring(entity, 1, 1)").alias("gender"))
    persons = named.groupBy("person").agg(F.collect_set("gender").alias("genders")).transform(in_arrow(
        _persons(key), "kind string, entity string, mention string, draw int"
    ))
    given = persons.filter("kind = 'given'").select("kind", "entity", "mention")
    drawn = assign(entities.filter("kind <> 'given'").unionByName(given), key)
    exceptions = materialize(drawn.unionByName(persons.filter("kind = 'gender'").select("kind", "entity", "draw")), "exceptions")
    schema = f"id {src.schema['id'].dataType.simpleString()}, text string, spans array<struct<kind:string,start:int,end:int>>"
    release(docs.sparkSession, entities)
    few = exceptions.limit(exceptions_limit + 1).collect()
    if len(few) <= exceptions_limit:
        send = docs.sparkSession.sparkContext.broadcast({(r["kind"], r["entity"]): r["draw"] for r in few})
        out = src.transform(in_arrow(_replacer(key, lambda: send.value), schema))
    else:
        row = F.xxhash64("id", "text")

        def held(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _sliced(batches):
                pairs = {
                    (r, *e)
                    for r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    for m in mentions(t or "")
                    for e in _keys(m[2], m[3])
                }
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[k] for p in pairs], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))],
                    names=["row", "kind", "entity"]
                )

        of_row = src.select(row.alias("row"), "text").transform(in_arrow(held, "row long, kind string, entity string")).distinct()
        draws = of_row.join(exceptions, ["kind", "entity"]).groupBy("row").agg(F.collect_list(F.struct("kind", "entity", "draw")).alias("draws"))
        out = src.withColumn("row", row).join(draws, "row", "left").select("id", "text", "draws").transform(in_arrow(_replacer(key, None), schema))
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "spans")
