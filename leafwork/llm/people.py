"""Variant spellings of one person's name."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwork.llm.bktree import levenshtein
from leafwork.operators.graph import components
from leafwork.operators.match import salted_join
from leafwork.session import cut, forget, kept, small

# Letters that are heard or written for each other.
_SOUND = {c: k for k, cs in {"b": "bp", "v": "fvw", "k": "ckq", "g": "gj", "s": "sxz", "d": "dt", "l": "l", "m": "m", "n": "n", "r": "r", "a": "a", "e": "e", "i": "iy", "o": "o", "u": "u"}.items() for c in cs}


#: Different names that are broadcast, at most; more are joined by a shuffle.
NAMES_SENT = 500_000


def phonetic(name: str) -> str:
    """Sound classes of the letters of the name's sorted tokens; doubled sounds count once."""
    out, last = "", ""
    for c in "".join(sorted(name.split())):
        k = _SOUND.get(c, "")
        if k != last:
            out += k
        last = k
    return out


def block_keys(name: str) -> list[str]:
    """The phonetic code and the code with each symbol left out, sounds that meet counted once; of a name of few sounds, the name with each letter left out.

    Codes that differ by a letter put in, left out, replaced or swapped with the
    next share a key, and few others do, so blocks stay small however many
    names there are. Codes of three symbols less one would be shared by most
    short names, so these go by their letters.
    """
    code = phonetic(name)
    if len(code) > 3:
        return sorted({code, *(code[:i] + code[i + 1 + (0 < i < len(code) - 1 and code[i - 1] == code[i + 1]) :] for i in range(len(code)))})
    return sorted({code, f"={name}", *(f"={name[:i]}{name[i + 1 :]}" for i in range(len(name)))})


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    swaps = sum(x != y for x, y in zip(hits, (c for c, u in zip(b, used, strict=True) if u), strict=True)) / 2
    m = len(hits)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    start = 0
    while start < min(4, len(a), len(b)) and a[start] == b[start]:
        start += 1
    return jaro + start * 0.1 * (1 - jaro)


def refines(general: str, special: str) -> bool:
    """Whether ``general`` (initials or an abbreviation ending in ``.``, or nothing) can stand for ``special``."""
    if general == special or not general:
        return True
    if not general.endswith("."):
        return False
    want, have = general.rstrip(".").split(".-"), special.rstrip(".").replace(".-", "-").split("-")
    return len(want) <= len(have) and all(h.startswith(w) for w, h in zip(want, have)) and (len(want) == len(have) or len(want[0]) > 1)


def compatible(a: str, b: str) -> bool:
    return refines(a, b) or refines(b, a)


def _keys_of(names: pd.Series) -> pd.Series:
    return names.map(block_keys)


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        jw = [jaro_winkler(a, b) for a, b in zip(x["f"], x["g"], strict=True)]
        edits = [levenshtein(a, b) for a, b in zip(x["f"], x["g"], strict=True)]
        yield x.assign(jw=jw, edits=edits)


def _fitting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        yield x[[compatible(a, b) for a, b in zip(x["p"], x["q"], strict=True)]][["f", "g"]].drop_duplicates()


def turned_names(rows: DataFrame) -> DataFrame:
    """surname, given, other_surname, other_given, turned: names that can be read in two orders and are likelier in the other.

    ``rows`` has surname, given, and other_surname and other_given where both
    readings are open. Names of one order, by a comma, capitals or initials,
    tell how often a word is a surname and how often a given name in this
    corpus; what stands more often as the reading has it decides, and the first
    reading is kept on a tie. The counts are joined to the different open names.
    """
    whole = "given <> '' AND NOT given LIKE '%.'"
    said = lambda df, role, word: df.select(F.lit(role).alias("role"), F.col(word).alias("word"))
    sure = rows.where("other_surname IS NULL")
    counts = said(sure.where(whole), "given", "given").union(said(sure, "surname", "surname")).groupBy("role", "word").agg(F.count(F.lit(1)).alias("n"))
    names = ["surname", "given", "other_surname", "other_given"]
    open_ = rows.where("other_surname IS NOT NULL").select(*names).distinct()
    vote = lambda role, word, sign: F.struct(F.lit(role).alias("role"), F.col(word).alias("word"), F.lit(sign).alias("sign"))
    votes = F.array(vote("given", "given", -1), vote("surname", "surname", -1), vote("given", "other_given", 1), vote("surname", "other_surname", 1))
    votes = open_.select(*names, F.explode(votes).alias("v")).select(*names, "v.*")
    return votes.join(counts, ["role", "word"]).groupBy(*names).agg(F.sum(F.col("sign") * F.col("n")).alias("more")).where("more > 0").select(*names, F.lit(True).alias("turned"))


def settled(rows: DataFrame, turned: DataFrame | None = None) -> DataFrame:
    """``rows`` with surname and given in the likelier order, by :func:`turned_names` of the rows or those given."""
    turned = small(cut(turned_names(rows)) if turned is None else turned, NAMES_SENT)
    out = rows.join(turned, ["surname", "given", "other_surname", "other_given"], "left")
    names = {c: F.when(F.col("turned"), F.col(f"other_{c}")).otherwise(F.col(c)) for c in ("surname", "given")}
    return out.withColumns(names).drop("turned", "other_surname", "other_given")


def learned_forms(named: DataFrame, surnames: int = 3) -> DataFrame:
    """given, formal: given names that stand for another: both are named for one work of one surname, with ``surnames`` different ones.

    ``named`` has cluster, work, given. The rarer of a pair stands for the
    commoner, if several for the one it goes with most. Of one work few given
    names are known, so pairs within it are few.
    """
    full = named.where("work IS NOT NULL AND given <> '' AND NOT given LIKE '%.'").select("cluster", "work", "given").distinct()
    several = full.groupBy("cluster", "work").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("cluster", "work")
    full = full.join(several, ["cluster", "work"])
    pairs = full.join(full.withColumnRenamed("given", "formal"), ["cluster", "work"]).where("given <> formal").groupBy("given", "formal").agg(F.countDistinct("cluster").alias("k")).where(F.col("k") >= surnames)
    often = named.groupBy("given").agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.join(often, "given").join(often.toDF("formal", "m"), "formal").where("m > n OR (m = n AND formal < given)")
    return pairs.groupBy("given").agg(F.max_by("formal", F.struct("k", "m", "formal")).alias("formal"))


def formal(named: DataFrame, learned: DataFrame | None = None) -> DataFrame:
    """``named`` with each given name in the form it stands for in this corpus, by :func:`learned_forms` of it or those given."""
    learned = small(cut(learned_forms(named)) if learned is None else learned, NAMES_SENT)
    return named.join(learned, "given", "left").withColumn("given", F.coalesce("formal", "given")).drop("formal")


def surname_clusters(mentions: DataFrame) -> DataFrame:
    """surname, cluster: spellings taken for one surname bear the same cluster.

    ``mentions`` has rec, surname, given, work (see :func:`people`). Distinct
    spellings are blocked by their phonetic codes with one symbol left out and
    compared by Jaro-Winkler; the given names must go together, nicknames
    counting as the name. A spelling is linked to those of its own records and
    to one other that more records bear, the likeliest: nearly equal, and either
    naming the same work or so much more frequent that the rarer spelling is a
    slip. Connected components make the clusters.
    """
    names = mentions.where("surname IS NOT NULL")
    forms = names.groupBy("surname").agg(F.countDistinct("rec").alias("n"))
    keys = F.pandas_udf(_keys_of, T.ArrayType(T.StringType()))
    blocked = kept(forms.select("surname", "n", F.explode(keys("surname")).alias("key")))
    f, g = blocked.toDF("f", "nf", "key"), blocked.toDF("g", "ng", "key")
    heavier = (F.col("ng") > F.col("nf")) | ((F.col("ng") == F.col("nf")) & (F.col("g") < F.col("f")))
    near = F.abs(F.length("f") - F.length("g")) <= 3

    in_rec = names.select("rec", "surname").distinct()
    together = in_rec.toDF("rec", "f").join(in_rec.toDF("rec", "g"), "rec").where("f <> g").select("f", "g").distinct().withColumn("together", F.lit(1))
    blocked_pairs = f.join(g, "key").where(near).drop("key")
    pairs = blocked_pairs.unionByName(together.select("f", "g").join(forms.toDF("f", "nf"), "f").join(forms.toDF("g", "ng"), "g")).where(heavier).distinct()
    pairs = kept(pairs.mapInPandas(_judge, "f string, g string, nf long, ng long, jw double, edits long").where("jw >= 0.8").join(together, ["f", "g"], "left"))
    forget(blocked)
    in_work = names.where("work IS NOT NULL").select("work", "surname").distinct()
    by_work = in_work.join(in_work.groupBy("work").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "work").select("work", "surname")
    close = pairs.where("together IS NULL AND jw >= 0.85 AND edits <= 3").select("f", "g")
    same_work = close.join(by_work.toDF("work", "f"), "f").join(by_work.toDF("work", "g"), ["work", "g"]).select("f", "g").distinct().withColumn("works", F.lit(1))
    judged = pairs.join(same_work, ["f", "g"], "left").na.fill(0, ["together", "works"])
    slip = F.col("nf") <= F.greatest(F.lit(2), F.col("ng") / 4)
    likely = judged.where((F.col("together") > 0) | (F.col("works") > 0) | ((F.col("jw") >= 0.92) & (F.col("edits") <= 2) & slip))
    # Given names are held together for the few pairs that are left, each name with each; no list of them is built.
    given = names.select("surname", "given").distinct()
    fits = likely.where("together = 0").select("f", "g").join(given.toDF("f", "p"), "f").join(given.toDF("g", "q"), "g").mapInPandas(_fitting, "f string, g string").distinct().withColumn("fit", F.lit(True))
    weight = F.struct("works", F.round("jw", 6).alias("jw"), F.col("ng"), F.col("g"))
    accepted = kept(likely.join(fits, ["f", "g"], "left").where("together > 0 OR fit").select("f", "g", "together", weight.alias("weight")))
    forget(pairs)
    chosen = accepted.groupBy("f").agg(F.max_by("g", "weight").alias("g")).unionByName(accepted.where("together > 0").select("f", "g"))
    linked = components(chosen, "f", "g").toDF("surname", "cluster")
    clusters = cut(forms.select("surname").join(linked, "surname", "left").select("surname", F.coalesce("cluster", "surname").alias("cluster")))
    forget(accepted)
    return clusters


def _refining(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        yield x[[refines(a, b) for a, b in zip(x["given"], x["special"], strict=True)]]


def people(mentions: DataFrame) -> DataFrame:
    """rec, person: the person each record names; records that may name several are left out.

    ``mentions`` has rec, surname, given and work: one row for each way a record
    names its author, ``given`` being a full name, an abbreviation or initials
    ending in ``.``, or empty, and ``work`` any key of the work, or null.

    Within a cluster of spellings a given name that no other refines is a
    person. A shorter form is the only person that refines it, or else the only
    such person named on the same work. Null or empty surnames name nobody;
    a null given name counts as empty; repeated rows change nothing; a record
    without a mention, and an empty table, give no row. All steps run on
    distinct forms; nothing gathers the records of one name in a task.
    """
    rows = mentions.select("rec", "surname", F.coalesce("given", F.lit("")).alias("given"), "work").where("surname <> ''").distinct()
    rows = cut(rows)
    named = formal(rows.join(small(surname_clusters(rows), NAMES_SENT), "surname"))
    exact = F.struct(~F.col("given").endswith("."), F.length("given"), F.col("given"))
    best = cut(named.groupBy("rec").agg(F.max_by(F.struct("cluster", "given"), exact).alias("b"), F.min("work").alias("work")).select("rec", "b.cluster", "b.given", "work"))

    forms = best.select("cluster", "given").distinct()
    special = forms.select("cluster", F.col("given").alias("special"))
    above = forms.join(special, "cluster").where("given <> special").mapInPandas(_refining, "cluster string, given string, special string")
    above = cut(above)
    tops = forms.join(above.select("cluster", "given"), ["cluster", "given"], "left_anti")
    choices = above.join(tops.select("cluster", F.col("given").alias("special")), ["cluster", "special"], "left_semi")
    single = choices.groupBy("cluster", "given").agg(F.count(F.lit(1)).alias("k"), F.min("special").alias("special"))
    sure = tops.select("cluster", "given", F.col("given").alias("special")).unionByName(single.where("k = 1").select("cluster", "given", "special"))
    first = best.join(sure, ["cluster", "given"]).select("rec", "cluster", "special", "work")

    open_ = best.join(single.where("k > 1").select("cluster", "given"), ["cluster", "given"], "left_semi").where("work IS NOT NULL")
    on_work = first.where("work IS NOT NULL").select("cluster", "work", "special").distinct()
    second = open_.join(choices, ["cluster", "given"]).join(on_work, ["cluster", "work", "special"]).groupBy("rec", "cluster").agg(F.count(F.lit(1)).alias("k"), F.min("special").alias("special")).where("k = 1")
    found = first.select("rec", "cluster", "special").unionByName(second.select("rec", "cluster", "special"))
    return found.select("rec", F.concat_ws("|", "cluster", "special").alias("person"))


def same_person_pairs(found: DataFrame) -> DataFrame:
    """rec_a, rec_b: records of one person, smaller first. One side of a hot person is salted."""
    a, b = found.toDF("rec_a", "person"), found.toDF("rec_b", "person")
    return salted_join(a, b, ["person"]).where("rec_a < rec_b").select("rec_a", "rec_b")
