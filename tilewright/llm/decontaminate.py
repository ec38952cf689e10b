"""Benchmark decontamination by templates, with DataFrame functions only.

A text becomes a sequence of template tokens: a number is ``<num>``, a unit behind a number is
``<unit>``, a capitalised word inside a sentence is ``<name>``, any other word is itself in lower
case; punctuation separates. Windows of eight tokens of a benchmark item are joined by hash with the
windows of all documents. Matches that lie on one diagonal (document position minus item position)
belong to one occurrence. It counts if six windows match, or all windows of a shorter item, and if the
slots are consistent: equal values in the item stand for equal values in the document and the other
way round. So a question with other numbers or names is caught, and a text that only shares a form
with inconsistent values is not.

A first pass finds the documents that are then compared window by window. It leaves out none: a window
that matches holds four parts of five tokens in a row that match in the same form, and one of any four
starts in a row is a multiple of four. So the hashes of every fourth part of a document are enough.

A third form, ``loose``, has every capitalised word as ``<name>``, first words of sentences too, so a
question whose sentences begin with other names is caught (``starts``). What the third form adds is judged
by itself, with first words as slots, so it never undoes what the other two find.

An item of four to seven tokens is one window of its own length; shorter items take no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import stored

WINDOW, LEAST, SHORTEST, PART = 8, 6, 4, 5
#: Keys (hashes of windows, ids of documents with a match) up to which they travel to every task.
BROADCAST_ROWS = 1_000_000

#: Tokens, sentence ends, and units that may follow a number.
TOKEN = r"[0-9]+(?:[.,:/][0-9]+)*|\p{L}[\p{L}\p{M}]*|[.!?:;%°€$£\n]"
STOPS = (".", "!", "?", ":", ";", "\n")
UNITS = (
    "%", "°", "$", "€", "£", "mm", "cm", "dm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "ms", "min", "h",
    "hz", "w", "kw", "v", "a", "j", "k", "n", "pa", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles",
    "ounce", "ounces", "pound", "pounds", "gallon", "gallons", "liter", "liters", "litre", "litres", "meter", "meters",
    "metre", "metres", "gram", "grams", "kilogram", "kilograms", "kilometer", "kilometers", "second", "seconds",
    "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "dollar", "dollars", "cent", "cents", "euro", "euros", "percent", "degree", "degrees",
)


def _listed(values) -> str:
    return ", ".join("'" + v.replace("\n", "\\n") + "'" for v in values)


def templates(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, plain, typed, loose, value)``: equally long arrays of template tokens and of what fills them.

    ``plain`` keeps names as words, ``typed`` has them as ``<name>``, ``loose`` also the capitalised first
    words of sentences; a null text has no tokens.
    """
    # most tokens start with a small letter from a to z; the first case settles them with few comparisons
    raw = rows.select(F.col(key).alias("key"), F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0)).alias("raw"))
    number = "w >= '0' and w < ':'"
    unit = f"get(raw, i - 1) < ':' and get(raw, i - 1) >= '0' and lower(w) in ({_listed(UNITS)})"
    marks = dict.fromkeys((*STOPS, "%", "°", "$", "€", "£"))
    told = raw.select(
        "key",
        F.expr(
            f"""filter(transform(raw, (w, i) -> named_struct(
                'value', lower(w),
                'kind', case when w >= 'a' and w < '{{' then if({unit}, '<unit>', 'w')
                             when {number} then '<num>'
                             when {unit} then '<unit>'
                             when w in ({_listed(marks)}) then ''
                             when left(w, 1) <> lower(left(w, 1)) and substr(w, 2) = lower(substr(w, 2)) and length(w) > 1
                                  then if(i > 0 and get(raw, i - 1) not in ({_listed(STOPS)}), '<name>', '<start>')
                             else 'w' end)), t -> t.kind <> '')"""
        ).alias("told"),
    )
    return told.select(
        "key",
        F.expr("transform(told, t -> case when t.kind in ('w', '<name>', '<start>') then t.value else t.kind end)").alias("plain"),
        F.expr("transform(told, t -> case when t.kind in ('w', '<start>') then t.value else t.kind end)").alias("typed"),
        F.expr("transform(told, t -> case t.kind when 'w' then t.value when '<start>' then '<name>' else t.kind end)").alias("loose"),
        F.expr("told.value").alias("value"),
    )


def _windows(n: int, starts: bool, where: str = "true", step: int = 1) -> str:
    """Hashes of the windows of n tokens at every ``step``-th place; those of the other forms follow where they differ."""
    each = "transform(sequence(0, size(plain) - {n}, {step}), i -> xxhash64(slice({form}, i + 1, {n})))"
    plain, typed, loose = (each.format(n=n, form=f, step=step) for f in ("plain", "typed", "loose"))
    if starts:
        forms = f"concat({plain}, if(typed <> plain, {typed}, array()), if(loose <> typed, {loose}, array()))"
    else:
        forms = f"if(array_contains(typed, '<name>'), concat({plain}, {typed}), {plain})"
    return f"case when size(plain) >= {n} and {where} then {forms} else array() end"


def _hashed(told: DataFrame, lengths: list[int], starts: bool, short: bool = False) -> DataFrame:
    """``(key, length, size, at, hash)``; ``short``: windows below the full length are whole items."""
    parts = [
        told.select(
            "key", F.lit(n).alias("length"), F.size("plain").alias("size"), F.posexplode(F.expr(_windows(n, starts, f"size(plain) = {n}" if short and n < WINDOW else "true"))).alias("at", "hash")
        )
        for n in lengths
    ]
    every = reduce(DataFrame.union, parts)
    return every.select("key", "length", (F.col("at") % (F.col("size") - F.col("length") + 1)).alias("at"), "hash")


def _candidates(told: DataFrame, wanted: DataFrame, items: DataFrame, lengths: list[int], starts: bool) -> DataFrame:
    """Keys of all documents with a window of an item."""
    whole = [n for n in lengths if n < WINDOW]
    keys = wanted.where(F.col("length") < WINDOW).select("hash")
    some = [told.select("key", F.explode(F.expr(_windows(n, starts))).alias("hash")) for n in whole]
    if WINDOW in lengths:
        keys = keys.union(items.where(F.size("plain") >= WINDOW).select(F.explode(F.expr(_windows(PART, starts)))))
        some.append(told.select("key", F.explode(F.expr(_windows(PART, starts, step=WINDOW - PART + 1))).alias("hash")))
    hashes = _small(stored(keys.distinct(), "parts"))
    return stored(reduce(DataFrame.union, some).join(hashes, "hash", "left_semi").select("key").distinct(), "candidates")


def _small(keys: DataFrame) -> DataFrame:
    """Keys for a broadcast if they are few; beyond that both sides are shuffled."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def matches(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", starts: bool = True) -> DataFrame:
    """``(doc_id, item_id, n_windows, share, n_slots)`` for each document and item it contains.

    ``n_windows`` counts matching windows of the best occurrence, ``share`` is their part of the
    item's windows, ``n_slots`` the item's slot values seen. Null and empty texts match nothing; rows
    without an id are not judged; rows that share an id are judged together. Empty tables give no rows.
    ``starts``: capitalised first words of sentences can be names, too.
    """
    items = stored(templates(bench.where(F.col(item).isNotNull()), item, item_text), "items").where(F.size("plain") >= SHORTEST)
    sizes = [r[0] for r in items.select(F.least(F.size("plain"), F.lit(WINDOW)).alias("n")).distinct().collect()]  # 4 to 8
    lengths = sorted(sizes) or [WINDOW]
    wanted = stored(_hashed(items, lengths, starts, short=True).withColumnRenamed("key", "item_id").withColumnRenamed("at", "item_at"), "windows")
    told = templates(docs.where(F.col(id_col).isNotNull()), id_col, text)
    ids = _small(_candidates(told, wanted, items, lengths, starts).withColumnRenamed("key", id_col))
    found = stored(templates(docs.join(ids, id_col, "left_semi"), id_col, text), "candidates")
    hashes = _small(wanted.select("hash").distinct())
    seen = _hashed(found, lengths, starts).join(hashes, "hash", "left_semi").withColumnRenamed("key", "doc_id")
    pairs = seen.join(wanted, ["hash", "length"]).select("doc_id", "item_id", "length", "at", "item_at").distinct()

    # the tokens themselves decide, and show what fills the slots
    of_doc = found.select(F.col("key").alias("doc_id"), F.col("plain").alias("dp"), F.col("typed").alias("dt"), F.col("loose").alias("dl"), F.col("value").alias("dv"))
    of_item = items.select(F.col("key").alias("item_id"), F.col("plain").alias("ip"), F.col("typed").alias("it"), F.col("loose").alias("il"), F.col("value").alias("iv"))
    cut = lambda name, at: f"slice({name}, {at} + 1, length)"
    names = ["doc_id", "item_id", "length", "at", "item_at"]
    sliced = pairs.join(of_doc, "doc_id").select(*names, *(F.expr(cut(c, "at")).alias(c) for c in ("dp", "dt", "dl", "dv")))
    held = (
        sliced.join(of_item, "item_id")
        .select(*names, "dp", "dt", "dl", "dv", F.expr("size(ip) - length + 1").alias("of"), *(F.expr(cut(c, "item_at")).alias(c) for c in ("ip", "it", "il", "iv")))
        .select("doc_id", "item_id", "at", "item_at", "of", F.expr("dp = ip or dt = it").alias("same"), F.expr("dl = il" if starts else "false").alias("alike"), "it", "il", "iv", "dv")
        .where("same or alike")
        .withColumn("wider", F.explode(F.expr("if(same, array(false, true), array(true))" if starts else "array(false)")))  # with the third form
        .withColumn("kind", F.expr("if(wider, il, it)"))
        .select(
            "doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal"), "item_at", "of", "wider",
            F.expr("transform(filter(arrays_zip(kind, iv, dv), z -> z.kind like '<%'), z -> struct(z.iv as mine, z.dv as theirs))").alias("slots"),
        )
    )
    by = ["doc_id", "item_id", "diagonal", "wider"]
    counted = held.groupBy(by).agg(F.count_distinct("item_at").alias("n_windows"), F.max("of").alias("of"))
    slots = held.select(*by, F.explode("slots").alias("s")).groupBy(by).agg(
        F.count_distinct("s").alias("n_pairs"), F.count_distinct("s.mine").alias("n_mine"), F.count_distinct("s.theirs").alias("n_theirs")
    )
    judged = counted.join(slots, by, "left").where(
        (F.col("n_windows") >= F.least(F.lit(LEAST), F.col("of")))
        & (F.col("n_pairs").isNull() | ((F.col("n_pairs") == F.col("n_mine")) & (F.col("n_pairs") == F.col("n_theirs"))))
    )
    best = judged.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("n_windows", (F.col("n_windows") / F.col("of")).alias("share"), F.coalesce("n_mine", F.lit(0)).alias("n_slots"))).alias("best")
    )
    return best.select("doc_id", "item_id", "best.*")


def drop_contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item; the columns stay as they are."""
    found = stored(matches(docs, bench, starts=True).select("doc_id").distinct(), "contaminated")
    return docs.join(_small(found), "doc_id", "left_anti").select(*docs.columns)


def _sql_templates(table: str, key: str) -> str:
    """The same tokens in DuckDB's SQL, one row for each."""
    units = ", ".join(f"'{u}'" for u in UNITS)
    stops = ", ".join("chr(10)" if s == "\n" else f"'{s}'" for s in STOPS)
    return f"""
    SELECT key, row_number() OVER (PARTITION BY key ORDER BY i) AS pos, count(*) OVER (PARTITION BY key) AS total, lower(w) AS val,
           CASE WHEN kind IN ('w', '<name>', '<start>') THEN lower(w) ELSE kind END AS plain, CASE WHEN kind IN ('w', '<start>') THEN lower(w) ELSE kind END AS typed,
           CASE kind WHEN 'w' THEN lower(w) WHEN '<start>' THEN '<name>' ELSE kind END AS loose
    FROM (SELECT *, CASE WHEN w >= '0' AND w < ':' THEN '<num>'
                         WHEN prev >= '0' AND prev < ':' AND lower(w) IN ({units}) THEN '<unit>'
                         WHEN w IN ({stops}) OR w IN ('%', '°', '$', '€', '£') THEN ''
                         WHEN w[1] <> lower(w[1]) AND w[2:] = lower(w[2:]) AND length(w) > 1
                              THEN CASE WHEN prev IS NOT NULL AND prev NOT IN ({stops}) THEN '<name>' ELSE '<start>' END
                         ELSE 'w' END AS kind
          FROM (SELECT key, i, w, lag(w) OVER (PARTITION BY key ORDER BY i) AS prev
                FROM (SELECT key, unnest(raw) AS w, generate_subscripts(raw, 1) AS i
                      FROM (SELECT {key} AS key, regexp_extract_all(coalesce(text, ''), '{TOKEN}') AS raw FROM {table} WHERE {key} IS NOT NULL))))
    WHERE kind <> ''"""


def _sql_windows(n: int, source: str, where: str) -> str:
    row = lambda c: "[" + ", ".join(f"lead({c}, {k}) OVER (PARTITION BY key ORDER BY pos)" for k in range(n)) + "]"
    return f"""SELECT key, {n} AS n, pos, total - {n} + 1 AS total, {row('plain')} AS p, {row('typed')} AS t, {row('loose')} AS l, {row('val')} AS v
        FROM {source} WHERE {where} QUALIFY pos <= {source}.total - {n} + 1"""


_SIZES = range(SHORTEST, WINDOW + 1)
ORACLE = f"""
WITH d AS MATERIALIZED ({_sql_templates("documents", "doc_id")}), b AS MATERIALIZED ({_sql_templates("benchmark", "item_id")}),
bwin AS MATERIALIZED ({" UNION ALL ".join(_sql_windows(n, "b", f"b.total {'>=' if n == WINDOW else '='} {n}") for n in _SIZES)}),
dwin AS ({" UNION ALL ".join(_sql_windows(n, "d", f"{n} IN (SELECT n FROM bwin)") for n in _SIZES)}),
met AS (SELECT dwin.key AS doc_id, bwin.key AS item_id, dwin.pos - bwin.pos AS diagonal, bwin.pos AS j, bwin.total AS total, bwin.t AS t, bwin.l AS l, bwin.v AS bv, dwin.v AS dv,
          dwin.p = bwin.p OR dwin.t = bwin.t AS same
        FROM dwin JOIN bwin ON dwin.n = bwin.n AND dwin.p = bwin.p
        UNION SELECT dwin.key, bwin.key, dwin.pos - bwin.pos, bwin.pos, bwin.total, bwin.t, bwin.l, bwin.v, dwin.v, TRUE FROM dwin JOIN bwin ON dwin.n = bwin.n AND dwin.t = bwin.t
        UNION SELECT dwin.key, bwin.key, dwin.pos - bwin.pos, bwin.pos, bwin.total, bwin.t, bwin.l, bwin.v, dwin.v, dwin.p = bwin.p OR dwin.t = bwin.t
        FROM dwin JOIN bwin ON dwin.n = bwin.n AND dwin.l = bwin.l),
hit AS (SELECT doc_id, item_id, diagonal, j, total, t AS kinds, bv, dv, FALSE AS wider FROM met WHERE same
        UNION ALL SELECT doc_id, item_id, diagonal, j, total, l, bv, dv, TRUE FROM met),
counted AS (SELECT doc_id, item_id, diagonal, wider, count(DISTINCT j) AS n_windows, max(total) AS total FROM hit GROUP BY ALL),
slot AS (SELECT doc_id, item_id, diagonal, wider, unnest(kinds) AS kind, unnest(bv) AS mine, unnest(dv) AS theirs FROM hit),
slots AS (SELECT doc_id, item_id, diagonal, wider, count(DISTINCT (mine, theirs)) AS n_pairs, count(DISTINCT mine) AS n_mine, count(DISTINCT theirs) AS n_theirs
          FROM slot WHERE kind LIKE '<%' GROUP BY ALL),
best AS (SELECT doc_id, item_id, n_windows, n_windows / total AS share, coalesce(n_mine, 0) AS n_slots,
                row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_windows DESC, n_windows / total DESC, coalesce(n_mine, 0) DESC) AS r
         FROM counted LEFT JOIN slots USING (doc_id, item_id, diagonal, wider)
         WHERE n_windows >= least({LEAST}, total) AND (n_pairs IS NULL OR (n_pairs = n_mine AND n_pairs = n_theirs)))
SELECT doc_id, item_id, n_windows, share, n_slots FROM best WHERE r = 1
"""
