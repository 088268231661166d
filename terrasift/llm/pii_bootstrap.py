"""Personal data by patterns of form, and unseen identifiers by bootstrapped patterns of context.

Seeds are the entities of the four plain forms (email, ip, card, phone) and opaque keys, long strings of digits and
letters mixed. Each seed, and each other token with a digit, is an instance of lexical patterns: the word before it,
the two words before it, the word after it, and its shape (kinds of character and length) after the word before it
and anywhere. The graph of patterns and instances is scored in turns. A pattern counts once enough distinct
instances known by then have it; its confidence is their share of all its occurrences in the corpus, whatever
stands there. An instance's score is the noisy-or of its patterns, and from CONFIDENT on it is known, so in the
next turn it induces patterns as seeds do. Tokens at patterns that end up confident are new spans, kind `id`.

All of it is DataFrame code; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.llm.common import stored, text_or_empty

#: Forms, as Java patterns that match what the plain forms match: `++` and the conditions on what precedes keep them
#: linear and free of recursion on long runs, \G lets a match begin where the last one ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "id")
#: A token of the text with a digit in it.
TOKEN = r"(?<!\S)(?=[^\s0-9]*+[0-9])\S++"
#: Letters and digits that a token must have to be an instance.
MIN_CHARS = 4
#: An opaque key: so many characters, digits and letters at least.
KEY_CHARS, KEY_EACH = 24, 6
#: Distinct known instances that make a pattern, confidence at which it adds spans, turns of scoring.
MIN_SEEDS, CONFIDENT, TURNS = 5, 0.7, 4
#: Characters around a token in which its neighbours are looked for; a longer word is cut, and is no pattern then.
AROUND = 400


def placed(text: Column, pattern: str, may: Column) -> Column:
    """array<struct<s, e, m>>: code-point start, end and text of the matches, left to right; none unless `may`."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.array().cast("array<struct<s:int,e:int,m:string>>").alias("out"), F.lit(0).alias("at"))
    step = lambda a, x: F.struct(
        F.concat(a["out"], F.array(F.struct((a["at"] + F.length(x["gap"])).alias("s"), (a["at"] + F.length(x["gap"]) + F.length(x["m"])).alias("e"), x["m"].alias("m")))).alias("out"),
        (a["at"] + F.length(x["gap"]) + F.length(x["m"])).alias("at"),
    )
    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
    return F.when(may, F.aggregate(pairs, start, step)["out"]).otherwise(F.array().cast("array<struct<s:int,e:int,m:string>>"))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def is_ip(m: Column) -> Column:
    bare = lambda p: F.ltrim(p, F.lit("0"))
    return F.forall(F.split(m, r"\."), lambda p: (F.length(bare(p)) < 3) | ((F.length(bare(p)) == 3) & (bare(p) <= "255")))


def is_card(m: Column) -> Column:
    d = F.reverse(digits(m))
    n = F.length(d)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, i + 1, F.lit(1)).cast("int")
        twice = 2 * x - F.when(x > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 1, twice).otherwise(x)

    return n.between(12, 19) & (F.aggregate(F.sequence(F.lit(0), F.least(n, F.lit(19)) - 1), F.lit(0), add) % 10 == 0)


def is_phone(m: Column) -> Column:
    return F.length(digits(m)).between(9, 15)


def shape(m: Column) -> Column:
    """Kinds of character of a token, each once in the order of first sight, and its length."""
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(m, "[0-9]+", "9"), r"\p{Ll}+", "a"), r"\p{Lu}+", "A")
    return F.concat(F.array_join(F.array_sort(F.array_distinct(F.split(kinds, ""))), ""), F.lit(":"), F.length(m))


def is_key(m: Column) -> Column:
    """Digits and letters of one case, mixed, in one long run."""
    n = F.length(digits(m))
    return F.length(m).between(KEY_CHARS, 512) & (m.rlike("^[a-z0-9]*$") | m.rlike("^[A-Z0-9]*$")) & (n >= KEY_EACH) & (F.length(m) - n >= KEY_EACH)


def scanned(docs: DataFrame) -> DataFrame:
    """rid, doc_id, and the base spans of each kind; seeds: those with what stands around them; tokens: the same of other tokens with a digit."""
    t = F.col("__t")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("__t"))
    found = rows.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", "__t",
        placed(t, EMAIL, F.contains(t, F.lit("@"))).alias("email"),
        placed(t, IP, t.rlike(r"[0-9]\.[0-9]")).alias("ip"),
        placed(t, CARD, t.rlike("[0-9][ -]?[0-9]")).alias("card"),
        placed(t, PHONE, F.contains(t, F.lit("+"))).alias("phone"),
        placed(t, TOKEN, t.rlike("[0-9]")).alias("token"),
    )
    core = lambda x: F.regexp_extract(x["m"], "[A-Za-z0-9].*[A-Za-z0-9]", 0)

    def instance(start: Column, text: Column, base: bool) -> Column:
        end = start + F.length(text)
        before = F.lower(F.substring(t, F.greatest(start - AROUND + 1, F.lit(1)), F.least(start, F.lit(AROUND))))
        words = F.filter(F.split(F.regexp_extract(before, r"(\S+\s+)?\S+\s*$", 0), r"\s+"), lambda w: w != "")
        after = F.regexp_extract(F.lower(F.substring(t, end + 1, F.lit(AROUND))), r"^\S*\s+(\S+)", 1)
        return F.struct(
            start.alias("s"), end.alias("e"), F.lower(text).alias("m"), F.element_at(F.concat(F.array(F.lit("")), words), -1).alias("one"),
            F.when(F.size(words) == 2, F.array_join(words, " ")).otherwise("").alias("two"), after.alias("after"),
            shape(text).alias("shape"), (F.lit(base) | is_key(text)).alias("seed"),
        )

    tokens = F.filter(F.col("token"), lambda x: F.length(F.regexp_replace(x["m"], "[^A-Za-z0-9]", "")) >= MIN_CHARS)
    found = found.select(
        "rid", "doc_id", "__t", "email", F.filter("ip", lambda x: is_ip(x["m"])).alias("ip"), F.filter("card", lambda x: is_card(x["m"])).alias("card"),
        F.filter("phone", lambda x: is_phone(x["m"])).alias("phone"), tokens.alias("token"),
    )
    seeds = F.transform(F.concat(*KINDS[:4]), lambda x: instance(x["s"], x["m"], True))
    others = F.transform("token", lambda x: instance((x["s"] + F.instr(x["m"], core(x)) - 1).cast("int"), core(x), False))
    return found.select("rid", "doc_id", *KINDS[:4], seeds.alias("seeds"), others.alias("tokens"))


def labelled(kind: str) -> Column:
    return F.transform(F.col(kind), lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e")))


def patterns_of() -> Column:
    """array of (p, gram) of an instance: its patterns, and the words whose occurrences are a pattern's (null: its instances are all)."""
    one = lambda kind, c, gram: F.struct(F.concat(F.lit(f"{kind} "), c).alias("p"), (c if gram else F.lit(None).cast("string")).alias("gram"))
    every = F.array(
        one("before", F.col("one"), True), one("two", F.col("two"), True), one("after", F.col("after"), True),
        one("shape", F.col("shape"), False), one("both", F.concat("shape", F.lit(" "), "one"), False),
    )
    return F.filter(every, lambda x: x["gram"].isNull() | (x["gram"] != ""))


def scored(edges: DataFrame) -> DataFrame:
    """p, confidence of patterns after all turns. edges: (p, m, n, seen, seed): instance m, n times at pattern p, which occurs `seen` times."""
    known = edges.where("seed").select("m", F.lit(1.0).alias("score")).distinct()
    weighed = None
    for _ in range(TURNS):
        got = edges.join(known, "m", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        weighed = got.groupBy("p").agg(
            F.count(F.when(F.col("score") >= CONFIDENT, 1)).alias("seeds"),
            F.least(F.lit(0.99), F.sum(F.col("n") * F.col("score")) / F.greatest(F.max("seen"), F.sum("n"))).alias("confidence"),
        ).where(F.col("seeds") >= MIN_SEEDS)
        weighed = stored(weighed.select("p", "confidence"), "confidence")
        by = edges.join(weighed, "p").groupBy("m").agg(F.max("seed").alias("seed"), (1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("by"))
        found = by.where(~F.col("seed") & (F.col("by") >= CONFIDENT)).select("m", F.col("by").alias("score"))
        known = stored(edges.where("seed").select("m", F.lit(1.0).alias("score")).distinct().unionByName(found), "known")
    return weighed


def discovered(docs: DataFrame, base: DataFrame) -> DataFrame:
    """rid and array `id` of (s, e) of tokens that confident patterns add. base: scanned() with column `spans`, all base spans in order."""
    free = lambda x: ~F.exists("spans", lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"]))
    seeds = base.where(F.size("seeds") > 0).select("rid", F.explode("seeds").alias("x"), F.lit(True).alias("base"))
    others = base.where(F.size("tokens") > 0).select("rid", F.explode(F.filter("tokens", free)).alias("x"), F.lit(False).alias("base"))
    pairs = seeds.unionByName(others).select("rid", "base", "x.*").select("rid", "base", "s", "e", "m", "seed", F.explode(patterns_of()).alias("x"))
    pairs = stored(pairs.select("rid", "base", "s", "e", "m", "seed", "x.p", "x.gram"), "pairs")
    edges = pairs.groupBy("p", "m").agg(F.first("gram").alias("gram"), F.count("*").alias("n"), F.max("seed").alias("seed"))
    # Only patterns of as many distinct instances can ever count.
    many = edges.groupBy("p").agg(F.count("*").alias("kinds")).where(F.col("kinds") >= MIN_SEEDS).select("p")
    edges = stored(edges.join(many, "p", "left_semi"), "edges")
    # Occurrences of the patterns' words in the whole corpus, whatever follows them.
    grams = stored(edges.where("gram is not null").select("gram").distinct(), "grams")
    words = F.filter(F.split(F.lower(text_or_empty()), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    each = docs.select(words.alias("w")).select(F.explode(F.concat(F.col("w"), F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)))).alias("gram"))
    seen = each.join(grams, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("seen"))
    edges = stored(edges.join(seen, "gram", "left").select("p", "m", "n", F.coalesce("seen", F.lit(0)).alias("seen"), "seed"), "graph")
    sure = scored(edges).where(F.col("confidence") >= CONFIDENT).select("p")
    return pairs.where(~F.col("base")).join(sure, "p", "left_semi").groupBy("rid").agg(F.collect_set(F.struct("s", F.lit(KINDS.index("id")).alias("k"), "e")).alias("id"))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base and spans: arrays of (s, k, e) in order, k an index of KINDS.

    Null and empty texts have none. Repeated rows have a result each; null ids stay null; an empty table gives no
    rows; columns besides doc_id and text are not read. Matches that fail their kind's condition are dropped and
    not tried again further right. Spans of different kinds may overlap; kind `id` overlaps none of the others.
    Texts of any length are read whole. Instances that differ in case only are one, as are repeated ones. A corpus
    with under MIN_SEEDS distinct seeds has no patterns, and so no span beyond the base.
    """
    base = scanned(docs)
    base = base.withColumn("spans", F.array_sort(F.concat(*[labelled(k) for k in KINDS[:4]])))
    base = stored(base.select("rid", "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]], "spans", "seeds", "tokens"), "spans")
    new = discovered(docs, base).withColumnRenamed("rid", "__rid")
    out = base.join(new, F.col("rid") == F.col("__rid"), "left")
    return out.select("doc_id", *[f"n_{k}" for k in KINDS[:4]], F.col("spans").alias("base"), F.when(F.col("id").isNull(), F.col("spans")).otherwise(F.array_sort(F.concat("spans", "id"))).alias("spans"))


def written(found: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat(F.element_at(names, x["k"] + 1), F.lit(":"), x["s"], F.lit(":"), x["e"])), ",")


def digests(docs: DataFrame) -> DataFrame:
    return spans(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
