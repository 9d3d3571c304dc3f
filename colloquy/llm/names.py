"""Variant spellings of names: which labels of a workspace denote the same person or organisation.

Labels are read as sets of tokens, so order doesn't matter. Whole names are blocked by the phonetic codes of their
sorted tokens, each code also with one sound left out, compared by Jaro-Winkler and a nickname table, and clustered by
connected components. Partial labels (a given name, an initial with a surname, a cut name, initials of an organisation)
then join the one cluster they fit, exactly, else by sound, else (single names, also with an initial) one slip apart; a
label that fits two clusters joins none.
"""

from __future__ import annotations

import itertools
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.graph import components
from colloquy.session import cut, join_small, spread

#: Given names and their short or foreign forms.
NICKNAMES_TEXT = """
abigail: abby abbie gail
alexander: alex alec sasha xander sandy alexandre alejandro
alexandra: alexa sandra
amara: mara
andrew: andy drew
anneliese: anne annie liese anna
anthony: tony
benjamin: ben benny benji
bjorn: bjoern
catherine: cathy cate
charles: charlie chuck
christopher: chris kit
daniel: dan danny
david: dave davy
dimitri: dima mitya dmitri dimitry
donald: don donnie
dorothea: dora thea dot dottie dorothy
edward: ed eddie ned ted teddy
elizabeth: liz lizzie beth betty eliza lisa libby bess
francisco: paco pancho fran frank cisco francis
giovanna: gianna vanna joanna gio
gregory: greg gregor
hakon: haakon
ingrid: inga inge
james: jim jimmy jamie
jennifer: jen jenny jenna
john: jack johnny
jose: pepe joe
joseph: joey
katherine: kathy kate katie kat kit kitty katharina
kenji: ken
konrad: conrad kurt kon
leila: lei leyla layla
margaret: maggie meg peggy greta marge margie
matthew: matt
meiling: mei ling
michael: mike mick mickey mikey
nathaniel: nate nathan nat
nicholas: nick nicky
olafur: olaf oli
oluwaseun: seun olu
patricia: pat patty trish
philippa: pippa pip phil
priyanka: priya pri
rebecca: becky becca
renee: ren
richard: rick dick rich ricky
robert: bob bobby rob robbie bert
samuel: sam sammy
stephen: steve steven
susanna: sue susie zuzana susan suzanne
theodore: theo ted teddy
thomas: tom tommy
tomasz: tomek
victoria: vicky vicki tori vic
william: will bill billy liam willy
yusuf: joseph yousef yussuf
zoe: zo
"""
#: Words of organisations and what they are short for; an empty right side drops the word.
ORGANISATION_TEXT = """
association=association assoc=association assn=association company=company co=company comp=company group=group grp=group
services=services service=services svcs=services svc=services svs=services international=international intl=international int=international
foundation=foundation fdn=foundation institute=institute inst=institute university=university univ=university corporation=corporation corp=corporation
partners=partners holdings=holdings solutions=solutions society=society council=council ministry=ministry department=department dept=department
"""
#: Legal forms, articles and titles that say nothing about who it is.
LEGAL = "ltd limited inc incorporated llc plc gmbh ag sa bv".split()
FILLERS = "the and of".split()
TITLES = "dr mr mrs ms miss mx prof professor sir dame rev herr frau mme mlle sr sra don jr".split()
#: Capitals of at most so many letters are read as initials, longer ones as a name.
INITIALS = 4
_NICK: dict[str, list[str]] = {}
for _line in NICKNAMES_TEXT.strip().splitlines():
    _full, _short = _line.split(":")
    for _n in _short.split():
        _NICK.setdefault(_n, []).append(_full)
_ORG = dict(x.split("=") for x in ORGANISATION_TEXT.split())
ORGANISATIONS = sorted(_ORG)
#: Numbered labels of machines.
MACHINE = r"^(speaker|spkr|spk|sp|s|channel|ch|participant|voice|unknown)[\s_\-#]*(\d+)$"
_MACHINE = re.compile(MACHINE, re.I)
_SPECIAL = str.maketrans({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "Æ": "Ae", "œ": "oe", "ı": "i"})
_OCR = str.maketrans("01354", "olesa")
_SOUND = str.maketrans({"c": "k", "q": "k", "g": "k", "x": "k", "z": "s", "v": "f", "w": "f", "b": "p", "d": "t", "m": "n", "j": "i", "y": "i"})


def fold(text: str) -> str:
    """Without accents and other letter marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text).translate(_SPECIAL) if not unicodedata.combining(c))


def code(token: str) -> str:
    """Phonetic code: sound classes of the consonants without doubles; a leading vowel stays as A."""
    t = token.replace("ph", "f").replace("ck", "k").replace("th", "t").replace("h", "") or token
    t = t.translate(_SOUND)
    head = "a" if t[0] in "aeiou" else t[0]
    body = re.sub(r"[aeiou]", "", t[1:])
    return re.sub(r"(.)\1+", r"\1", head + body).upper()


def less(c: str) -> list[str]:
    """The code itself and the code with each one sound left out."""
    return list(dict.fromkeys([c, *(re.sub(r"(.)\1+", r"\1", c[:i] + c[i + 1 :]) for i in range(len(c)))]))


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free, hits = [True] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == x:
                free[j] = False
                hits.append(x)
                break
    if not hits:
        return 0.0
    other = [y for y, f in zip(b, free) if not f]
    m, t = len(hits), sum(x != y for x, y in zip(hits, other)) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    head = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + 0.1 * head * (1 - jaro)


def one_slip(a: str, b: str) -> bool:
    """At most one letter added, left out, changed, or two neighbours swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    a, b = sorted((a, b), key=len)
    return a[i:] == b[i + 1 :]


def formal(token: str) -> str:
    """The given name a nickname stands for; of several the first in the table; else the token."""
    return _NICK.get(token, [token])[0]


def same_token(a: str, b: str) -> bool:
    """Equal, nickname of each other, or one slip apart and alike by Jaro-Winkler."""
    if a == b or set(_NICK.get(a, [a])) & set(_NICK.get(b, [b])):
        return True
    return min(len(a), len(b)) >= 4 and jaro_winkler(a, b) >= 0.85 and one_slip(a, b)


def same_name(a: list[str], b: list[str]) -> bool:
    """The tokens can be paired up: a perfect matching of what may be the same."""
    if len(a) != len(b):
        return False
    may = [[j for j, y in enumerate(b) if same_token(x, y)] for x in a]
    taken: dict[int, int] = {}

    def place(i: int, tried: set[int]) -> bool:
        """Finds a partner for token i, moving others on if need be."""
        for j in may[i]:
            if j not in tried:
                tried.add(j)
                if j not in taken or place(taken[j], tried):
                    taken[j] = i
                    return True
        return False

    return all(m and place(i, set()) for i, m in enumerate(may))


def parse_label(raw: str | None) -> dict:
    """kind (whole, initial, single, cut, short, machine, none), form (equal forms: same label), tokens, initial, prefix."""
    text = re.sub(r"\s+", " ", fold(raw or "")).strip(" \t:;,>*#-–—")
    out = {"kind": "none", "form": "N:" + text.lower(), "tokens": [], "initial": "", "prefix": ""}
    if m := _MACHINE.match(text):
        return out | {"kind": "machine", "form": f"M:{m[1].lower()} {int(m[2])}"}
    bare = re.sub(r"\s*(\([^)]*\)|\[[^\]]*\]|\{[^}]*\})", " ", text).strip()
    bare = re.sub(r"\s+[-–—]\s+.*$", "", bare) or bare
    bare = re.sub(r'["“”«»]([^"“”«»]*)["“”«»]', " ", bare) if re.search(r'\S\s+["“«]', bare) else re.sub(r'["“”«»]', " ", bare)
    bare = bare.strip(" :;,>") or text
    if " " not in bare:
        bare = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", bare)
    words, initials, prefix, org = [], [], "", False
    short = bare if re.fullmatch(r"[A-Z]{2,5}", bare) else ""
    for w in re.split(r"[\s,;/&+_]+|(?<=[A-Za-z])\.(?=[A-Za-z]{2})", bare):
        dotted, gone = w.endswith("."), w.endswith(("…", "..."))
        t = w.strip(".…'’`!?:").lower().replace("-", "").replace("'", "").replace("’", "")
        if any(c.isdigit() for c in t) and any(c.isalpha() for c in t):
            t = t.translate(_OCR)
        if not t or t in FILLERS or t in LEGAL or (t in TITLES and (len(t) > 1)):
            continue
        if t in _ORG:
            org = True
            words.append(_ORG[t])
        elif gone or (dotted and len(t) >= 3):
            prefix = t
        elif len(t) == 1:
            initials.append(t)
        else:
            words.append(t)
    words = sorted(dict.fromkeys(words if org else [formal(t) for t in words]))
    if prefix and words:
        return out | {"kind": "cut", "form": f"P:{' '.join(words)}|{prefix}", "tokens": words, "prefix": prefix}
    if len(words) >= 2:
        return out | {"kind": "whole", "form": "W:" + " ".join(words), "tokens": words}
    if len(words) == 1 and initials:
        return out | {"kind": "initial", "form": f"I:{words[0]}|{initials[0]}", "tokens": words, "initial": initials[0]}
    if short and len(short) <= INITIALS:
        return out | {"kind": "short", "form": "A:" + short.lower(), "tokens": words, "prefix": short.lower()}
    if words:
        return out | {"kind": "single", "form": "S:" + words[0], "tokens": words}
    return out


def block_keys(tokens: list[str]) -> list[str]:
    """Sorted phonetic codes; each with up to one sound left out (of three or more tokens only in one)."""
    codes = [code(t) for t in tokens]
    if len(codes) == 2:
        picks = itertools.product(*map(less, codes))
    else:
        picks = [[*codes[:i], v, *codes[i + 1 :]] for i in range(len(codes)) for v in less(codes[i])]
    return list({" ".join(sorted(p)) for p in picks})


def _initials(letters: str) -> str:
    """Initials in any order are one feature."""
    return "A:" + "".join(sorted(letters))


def features(tokens: list[str]) -> list[str]:
    """What partial labels may show of a whole name."""
    out = {f"T:{t}" for t in tokens} | {f"t:{code(t)}" for t in tokens}
    for t in tokens:
        rest = [x for x in tokens if x != t]
        out |= {f"P:{' '.join(rest)}|{t[:k]}" for k in range(3, len(t))}
        for x in rest if len(tokens) == 2 else []:
            out |= {f"I:{t}|{x[0]}", f"i:{code(t)}|{x[0]}"}
        if len(tokens) > 2:
            out.add("W:" + " ".join(rest))
    if len(tokens) > 2:
        out.add(_initials("".join(x[0] for x in tokens)))
    return sorted(out)


def near_features(tokens: list[str]) -> list[tuple[str, str]]:
    """Codes, with up to one sound left out, of the tokens that a slip may hide (four letters or more), each with its token; with the initial of the other token too."""
    out = set()
    for t in (t for t in tokens if len(t) >= 4):
        heads = {x[0] for x in tokens if x != t} if len(tokens) == 2 else set()
        out |= {(f, t) for v in less(code(t)) for f in [f"s:{v}", *(f"i:{v}|{x}" for x in heads)]}
    return sorted(out)


_PARSED = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "form")] + [T.StructField("tokens", T.ArrayType(T.StringType()))] + [T.StructField(n, T.StringType()) for n in ("first", "second")])


@F.pandas_udf(_PARSED)
def _parse(labels: pd.Series) -> pd.DataFrame:
    rows = []
    for x in labels:
        p = parse_label(x)
        t = p["tokens"]
        first = second = None
        if p["kind"] == "cut":
            first = p["form"]
        elif p["kind"] == "initial":
            first, second = p["form"], f"i:{code(t[0])}|{p['initial']}"
        elif p["kind"] == "single":
            first, second = f"T:{t[0]}", f"t:{code(t[0])}"
        elif p["kind"] == "short":
            first, second = _initials(p["prefix"]), f"T:{p['prefix']}"
        elif p["kind"] == "whole":
            first = p["form"]
        rows.append((p["kind"], p["form"], t, first, second))
    return pd.DataFrame(rows, columns=_PARSED.names)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _keys(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: block_keys(list(t)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _features(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: features(list(t)))


_NEAR = T.ArrayType(T.StructType([T.StructField("f", T.StringType()), T.StructField("shown", T.StringType())]))


@F.pandas_udf(_NEAR)
def _near(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: [{"f": f, "shown": x} for f, x in near_features(list(t))])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _near_part(tokens: pd.Series, form: pd.Series) -> pd.Series:
    """The same codes of a partial label's one token."""
    return pd.Series([[f"i:{v}|{f[-1]}" if f.startswith("I:") else f"s:{v}" for v in less(code(t[0]))] if len(t[0]) >= 4 else [] for t, f in zip(tokens, form)], dtype=object)


@F.pandas_udf(T.BooleanType())
def _same_token(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same_token(x, y) for x, y in zip(a, b)], dtype=bool)


@F.pandas_udf(T.BooleanType())
def _same(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same_name(list(x), list(y)) for x, y in zip(a, b)], dtype=bool)


def _unique(rows: DataFrame) -> DataFrame:
    """Per feature: the group if there is only one, and whether there are several."""
    return rows.groupBy("feature").agg(F.min("group").alias("to"), (F.min("group") != F.max("group")).alias("many"))


def link_names(labels: DataFrame, scope: str, label: str) -> DataFrame:
    """(scope, label, kind, entity, fits_many) for every distinct label: labels with one entity denote the same.

    `fits_many`: a partial label that fits two or more; it stands alone under its own form. Numbered machine labels and
    labels without a letter are entities of their own spelling. NULL labels or scopes have no row; repeated rows and
    further columns don't matter; an empty table gives no rows. Forms, keys and features are joined by 64-bit hashes
    that include the scope.
    """
    key = lambda *c: F.xxhash64("scope", *c)
    x = labels.select(F.col(scope).alias("scope"), F.col(label).alias("label")).where("scope IS NOT NULL AND label IS NOT NULL").distinct()
    x = cut(spread(x).select("scope", "label", _parse("label").alias("_p")).select("scope", "label", "_p.*").withColumn("id", key("form")))
    forms = cut(x.select("scope", "form", "kind", "tokens", "first", "second", "id").dropDuplicates(["id"]))
    whole = forms.where("kind = 'whole'").select("scope", "id", "tokens")
    keyed = cut(whole.select("scope", "id", F.explode(_keys("tokens")).alias("k")).select("id", key("k").alias("key")))
    shared = cut(keyed.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key"))
    keyed = join_small(keyed, shared, ["key"], "left_semi", limit=500_000)  # most keys belong to one form
    a, b = (keyed.select("key", F.col("id").alias(n)) for n in "ab")
    pairs = a.join(b, "key").where("a < b").select("a", "b").distinct()
    of = lambda n: whole.select(F.col("id").alias(n), F.col("scope").alias(f"scope_{n}"), F.col("tokens").alias(f"tokens_{n}"))
    edges = pairs.join(of("a"), "a").join(of("b"), "b").where("scope_a = scope_b").where(_same("tokens_a", "tokens_b"))
    linked = components(edges.select("a", "b"))
    group = cut(whole.join(linked.withColumnRenamed("node", "id"), "id", "left").select("scope", "id", "tokens", F.coalesce("component", "id").alias("group")))
    shown = group.select("scope", "group", F.explode(_features("tokens")).alias("f")).select("group", key("f").alias("feature"))

    # a part of an organisation's name, an initial, a cut name, initials: exact first, by sound where nothing is exact
    one = cut(_unique(shown))
    part = forms.where("kind <> 'machine' AND kind <> 'none'").select("scope", "form", "id", "kind", "tokens", key("first").alias("first"), key("second").alias("second"))
    hit = lambda at, name: one.select(F.col("feature").alias(at), F.col("to").alias(f"to_{name}"), F.col("many").alias(f"many_{name}"))
    p = part.join(hit("first", "1"), "first", "left").join(hit("second", "2"), "second", "left").join(group.select("id", "group"), "id", "left")
    many = F.coalesce("many_1", "many_2", F.lit(False))
    to = F.when(F.col("many_1").isNotNull(), F.when(~F.col("many_1"), F.col("to_1"))).when(~F.col("many_2"), F.col("to_2"))
    placed = p.select("scope", "form", "id", "kind", "tokens", many.alias("many"), F.coalesce(to, "group", "id").alias("entity"), (to.isNull() & ~many & F.col("kind").isin("initial", "single")).alias("left"))
    placed = cut(placed)

    # a single name, or one with an initial, that nothing shows exactly or by sound: one slip apart from the names of one entity
    token = F.get("tokens", F.lit(0))
    loose = placed.where("left").select("scope", "id", token.alias("token"), F.explode(_near_part("tokens", "form")).alias("f"))
    loose = cut(loose.select("id", "token", key("f").alias("feature")))
    near = group.select("scope", "group", F.explode(_near("tokens")).alias("n")).select("group", "n.shown", key("n.f").alias("feature"))
    near = join_small(near, loose, ["feature"], "inner", limit=500_000).select("id", "token", "group", "shown").distinct().where(_same_token("token", "shown"))
    near = cut(near.groupBy("id").agg(F.min("group").alias("near"), (F.min("group") != F.max("group")).alias("several")))
    placed = join_small(placed, near, ["id"])
    placed = placed.select("scope", "form", "id", "kind", "tokens", (F.col("many") | F.coalesce("several", F.lit(False))).alias("many"), F.when(~F.col("several"), F.col("near")).otherwise(F.col("entity")).alias("entity"), (F.col("left") & F.col("near").isNull()).alias("left"))
    placed = cut(placed)

    # given names alone against initials whose bearer has no whole name here
    lone = placed.where("left AND kind = 'initial'").select("scope", F.col("entity").alias("group"), F.explode(F.array(F.concat(F.lit("T:"), token), F.concat(F.lit("L:"), F.substring_index("form", "|", -1)))).alias("f"))
    two = _unique(lone.select("group", key("f").alias("feature")))
    look = placed.where("left AND kind = 'single'").select("scope", "id", F.posexplode(F.array(F.concat(F.lit("T:"), token), F.concat(F.lit("L:"), F.substring(token, 1, 1)))).alias("n", "f"))
    found = look.select("id", "n", key("f").alias("feature")).join(two, "feature").groupBy("id").agg(F.min_by(F.struct("to", "many"), "n").alias("r"))
    ends = placed.join(found, "id", "left").select("id", F.when(~F.col("r.many"), F.col("r.to")).alias("late"), "entity", (F.col("many") | F.coalesce("r.many", F.lit(False))).alias("fits_many"))
    ends = ends.select("id", F.coalesce("late", "entity").alias("entity"), "fits_many")
    out = x.select("scope", "label", "kind", "id").join(ends, "id", "left")
    return out.select(F.col("scope").alias(scope), F.col("label").alias(label), "kind", F.coalesce("entity", "id").cast("string").alias("entity"), F.coalesce("fits_many", F.lit(False)).alias("fits_many"))


def linked_pairs(labels: DataFrame, scope: str = "workspace_id", label: str = "raw_speaker", key: str = "label_id") -> DataFrame:
    """(label_a, label_b): pairs of `key` of one scope, a < b, whose labels denote the same; see `link_names`."""
    linked = link_names(labels, scope, label).where("kind NOT IN ('machine', 'none') AND NOT fits_many").select(scope, label, "entity")
    ids = labels.select(F.col(key), scope, label).where(F.col(key).isNotNull()).dropDuplicates([key]).join(linked, [scope, label]).select(F.col(key).alias("id"), "entity")
    ids = cut(ids)
    a, b = (ids.select("entity", F.col("id").alias(f"label_{s}")) for s in "ab")
    return a.join(b, "entity").where("label_a < label_b").select("label_a", "label_b")
