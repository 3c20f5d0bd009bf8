"""Text preparation: repair, lines, blocks, chunks, tests and ids (T)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.plans.registry import query

CHUNK, LARGE = 1200, 7000
BLANK = r"[ \t\r\n\f]+"
#: Marks of extracted PDF text, words of prose, and stop words by language.
PDF_MARKS = r"%PDF-|endobj|endstream|/FlateDecode"
PROSE = ("the", "this", "that", "these", "those", "with", "from", "which")
STOP = {"en": "the of and to in is that it for with was are".split(), "de": "der die das und ist nicht ein den mit von zu im".split(), "fr": "le la les et des que est une dans pour qui sur".split(), "es": "el los las que una por con para del se su como".split()}


@query("T1", "documents", sql="SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[ \\t]+(\\n|$)', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text FROM documents")
def t1(documents):
    return documents.select("doc_id", repair(F.col("text")).alias("text"))


def repair(text: Column) -> Column:
    """Trailing blanks and surplus empty lines removed."""
    return F.btrim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+(\n|$)", "$1"), r"\n{3,}", "\n\n"), F.lit(" \n"))


def mojibake(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, read again, where its marks are there and the bytes are valid."""
    latin = F.when(text.rlike(r"[ÃÂ][\x80-\xBF]") & text.rlike(r"^[\x00-\xFF]*$"), text)
    return F.coalesce(F.try_validate_utf8(F.encode(latin, "iso-8859-1").cast("string")), text)


@query("T2", "lines", sql="SELECT doc_id, pos, trim(line) AS line FROM lines WHERE trim(line) <> ''")
def t2(lines):
    return lines.select("doc_id", "pos", F.trim("line").alias("line")).where("line <> ''")


def _norm(line: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(line)), r"\s+", " ")


@query("T3", "lines", sql="""
    WITH n AS (SELECT *, regexp_replace(lower(trim(line)), '\\s+', ' ', 'g') AS norm FROM lines), p AS (SELECT *, lag(norm) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM n)
    SELECT doc_id, pos FROM p WHERE norm = '' OR prev IS NULL OR norm <> prev""")
def t3(lines):
    """Lines without those equal to the line before."""
    prev = F.lag("norm").over(Window.partitionBy("doc_id").orderBy("pos"))
    n = lines.withColumn("norm", _norm(F.col("line"))).withColumn("prev", prev)
    return n.where((F.col("norm") == "") | F.col("prev").isNull() | (F.col("norm") != F.col("prev"))).select("doc_id", "pos")


@query("T4", "lines", sql="""
    WITH n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, lower(line)) AS k FROM lines)
    SELECT doc_id, pos FROM n WHERE NOT (k >= 3 AND length(line) BETWEEN 1 AND 29 AND NOT regexp_matches(line, '[.!?;:]\\s*$'))""")
def t4(lines):
    """Lines without repeated page headers: short, three times or more, no sentence's end."""
    k = lines.groupBy("doc_id", F.lower("line").alias("low")).agg(F.count("*").alias("k")).where("k >= 3")
    short = lines.where((F.length("line").between(1, 29)) & ~F.col("line").rlike(r"[.!?;:]\s*$")).withColumn("low", F.lower("line"))
    drop = short.join(k, ["doc_id", "low"], "left_semi").select("doc_id", "pos")
    return lines.join(drop, ["doc_id", "pos"], "left_anti").select("doc_id", "pos")


@query("T5", "lines", sql="""
    WITH w AS (SELECT doc_id, pos, string_split(regexp_replace(trim(line), '[ \\t]+', ' ', 'g'), ' ') AS w FROM lines WHERE trim(line) <> '')
    SELECT doc_id, pos, array_to_string(CASE WHEN len(w) >= 4 AND w[1:len(w)//2] = w[len(w)//2 + 1:2 * (len(w)//2)] THEN w[1:len(w)//2] ELSE w END, ' ') AS line FROM w""")
def t5(lines):
    """A phrase said twice in a line, said once."""
    w = lines.where("trim(line) <> ''").withColumn("w", F.split(F.regexp_replace(F.trim("line"), r"[ \t]+", " "), " "))
    half = F.floor(F.size("w") / 2).cast("int")
    twice = (F.size("w") >= 4) & (F.slice("w", 1, F.greatest(half, F.lit(1))) == F.slice("w", half + 1, F.greatest(half, F.lit(1))))
    return w.select("doc_id", "pos", F.array_join(F.when(twice, F.slice("w", 1, F.greatest(half, F.lit(1)))).otherwise(F.col("w")), " ").alias("line"))


def line_kind(line: Column) -> Column:
    """blank, header_meta, figure_caption, heading, diagram_label or body."""
    s = F.trim(line)
    words = F.split(s, r"\s+")
    label = (F.length(s) <= 40) & ~s.rlike(r"[.!?;:»\"]\s*$") & (F.size(words) <= 5) & ~F.arrays_overlap(F.transform(words, F.lower), F.array(*map(F.lit, PROSE)))
    return (
        F.when(s == "", "blank")
        .when(s.rlike(r"^\d{4}\s*г\.?\s*$|^\d{1,3}$"), "header_meta")
        .when(s.rlike(r"^(?:Рис\.|Рисунок|Fig\.|Figure)\s*\d+[.)]?\s*"), "figure_caption")
        .when(s.rlike(r"^\d+(?:\.\d+)*\.\s+.+$|^[A-ZА-ЯЁ\s\d\-–—]{4,}$"), "heading")
        .when(label, "diagram_label")
        .otherwise("body")
    )


@query("T6", "lines", sql=f"""
    WITH s AS (SELECT trim(line) AS s FROM lines), k AS (SELECT CASE WHEN s = '' THEN 'blank' WHEN regexp_matches(s, '^\\d{{4}}\\s*г\\.?\\s*$|^\\d{{1,3}}$') THEN 'header_meta'
      WHEN regexp_matches(s, '^(?:Рис\\.|Рисунок|Fig\\.|Figure)\\s*\\d+[.)]?\\s*') THEN 'figure_caption' WHEN regexp_matches(s, '^\\d+(?:\\.\\d+)*\\.\\s+.+$|^[A-ZА-ЯЁ\\s\\d\\-–—]{{4,}}$') THEN 'heading'
      WHEN length(s) <= 40 AND NOT regexp_matches(s, '[.!?;:»"]\\s*$') AND len(regexp_split_to_array(s, '\\s+')) <= 5 AND NOT list_has_any(list_transform(regexp_split_to_array(s, '\\s+'), lambda x: lower(x)), {list(PROSE)!r}) THEN 'diagram_label' ELSE 'body' END AS kind FROM s)
    SELECT kind, count(*) AS lines FROM k GROUP BY 1""")
def t6(lines):
    return lines.groupBy(line_kind(F.col("line")).alias("kind")).agg(F.count("*").alias("lines"))


@query("T7", "lines", sql="""
    WITH t AS (SELECT doc_id, pos, trim(line) AS s FROM lines WHERE trim(line) <> ''), p AS (SELECT *, lag(s) OVER w AS prev FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
         f AS (SELECT *, CASE WHEN prev IS NULL OR regexp_matches(prev, '[.!?;:]$') OR NOT (regexp_matches(s, '^\\p{Ll}') OR regexp_matches(prev, '[,–—-]$')) THEN 1 ELSE 0 END AS starts FROM p),
         g AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS block FROM f)
    SELECT doc_id, block::BIGINT AS block, string_agg(s, ' ' ORDER BY pos) AS text FROM g GROUP BY 1, 2""")
def t7(lines):
    """Broken lines merged: the next begins in lower case or the one before ends in a comma or dash, and no sentence ended."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    t = lines.select("doc_id", "pos", F.trim("line").alias("s")).where("s <> ''").withColumn("prev", F.lag("s").over(w))
    starts = F.col("prev").isNull() | F.col("prev").rlike("[.!?;:]$") | ~(F.col("s").rlike(r"^\p{Ll}") | F.col("prev").rlike("[,–—-]$"))
    g = t.withColumn("block", F.sum(starts.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("pos", "s")))
    return g.groupBy("doc_id", "block").agg(F.array_join(F.transform(parts, lambda x: x["s"]), " ").alias("text"))


@query("T8", "lines", sql="""
    WITH t AS (SELECT doc_id, pos, trim(line) AS s FROM lines WHERE trim(line) <> '')
    SELECT doc_id, string_agg(CASE WHEN regexp_matches(s, '^\\d{1,3}$') THEN '<!-- ' || s || ' -->' WHEN regexp_matches(s, '^\\d+(?:\\.\\d+)*\\.\\s+.+$|^[A-ZА-ЯЁ\\s\\d\\-–—]{4,}$') THEN '## ' || s ELSE s END, chr(10) || chr(10) ORDER BY pos) AS markdown FROM t GROUP BY 1""")
def t8(lines):
    """Lines assembled to Markdown blocks by kind."""
    kind = F.when(F.col("s").rlike(r"^\d{1,3}$"), F.concat(F.lit("<!-- "), "s", F.lit(" -->"))).when(F.col("s").rlike(r"^\d+(?:\.\d+)*\.\s+.+$|^[A-ZА-ЯЁ\s\d\-–—]{4,}$"), F.concat(F.lit("## "), "s")).otherwise(F.col("s"))
    t = lines.select("doc_id", "pos", F.trim("line").alias("s")).where("s <> ''").withColumn("block", kind)
    parts = F.array_sort(F.collect_list(F.struct("pos", "block")))
    return t.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["block"]), "\n\n").alias("markdown"))


def cut_long(block: Column, limit: int) -> Column:
    """A block cut into parts of at most limit characters, at the last blank beyond half of it where there is one."""

    def step(state: Column, _: Column) -> Column:
        rest = state["rest"]
        head = F.substring(rest, 1, limit)
        blank = F.length(head) - F.instr(F.reverse(head), " ") + 1
        at = F.when(F.length(rest) <= limit, F.length(rest)).when((F.instr(head, " ") > 0) & (blank > limit // 2), blank).otherwise(limit)
        part = F.btrim(F.substring(rest, F.lit(1), at))
        return F.struct(F.when(part == "", state["out"]).otherwise(F.array_append(state["out"], part)).alias("out"), F.substring(rest, at + 1, F.length(rest)).alias("rest"))

    steps = F.sequence(F.lit(1), F.ceil(F.length(block) / (limit // 2)).cast("int") + 1)
    return F.when(F.length(block) <= limit, F.array(block)).otherwise(F.aggregate(steps, F.struct(F.expr("cast(array() as array<string>)").alias("out"), block.alias("rest")), step, lambda s: s["out"]))


def pack(blocks: Column, limit: int, sep: str = "\n\n") -> Column:
    """Blocks packed greedily, in order, into chunks of at most limit characters."""

    def step(s: Column, x: Column) -> Column:
        fits = (s["buf"] == "") | (F.length(s["buf"]) + F.length(x) + len(sep) <= limit)
        joined = F.when(s["buf"] == "", x).otherwise(F.concat(s["buf"], F.lit(sep), x))
        return F.struct(F.when(fits, s["out"]).otherwise(F.array_append(s["out"], s["buf"])).alias("out"), F.when(fits, joined).otherwise(x).alias("buf"))

    start = F.struct(F.expr("cast(array() as array<string>)").alias("out"), F.lit("").alias("buf"))
    return F.aggregate(blocks, start, step, lambda s: F.when(s["buf"] == "", s["out"]).otherwise(F.array_append(s["out"], s["buf"])))


def chunks(docs: DataFrame, limit: int = CHUNK, block_sep: str = "\n", id_col: str = "doc_id") -> DataFrame:
    """id, idx, kind, text: headings and tables alone, paragraphs packed up to limit characters."""
    blocks = F.filter(F.transform(F.split("text", block_sep, -1), lambda b: F.btrim(b)), lambda b: b != "")
    alone = lambda b: b.rlike(r"^#{1,6} |^\|")
    # blocks that stand alone are told before long ones are cut: what a cut leaves in front may look like one
    parts = F.flatten(F.transform(blocks, lambda b: F.when(alone(b), F.array(F.concat(F.lit("\x1e"), b, F.lit("\x1e")))).otherwise(cut_long(b, limit))))
    # runs of paragraphs between blocks that stand alone
    marked = F.transform(F.split(F.array_join(parts, "\x1f"), "\x1e"), lambda run: F.filter(F.split(run, "\x1f"), lambda b: b != ""))
    packed = F.flatten(F.transform(marked, lambda run: pack(run, limit)))
    out = docs.select(id_col, F.posexplode(packed).alias("idx", "text"))
    return out.select(id_col, "idx", F.when(F.col("text").rlike("^#{1,6} "), "heading").when(F.col("text").startswith("|"), "table").otherwise("paragraph").alias("kind"), "text")


def chunk_sql(limit: int) -> str:
    """The same as CTEs that end in chunked(doc_id, idx, kind, text): blocks, long ones cut step by step, runs packed by a fold."""
    alone = "regexp_matches({0}, '^#{{1,6}} |^\\|')"
    return f"""cb AS (SELECT doc_id, b, trim(block) AS block FROM (SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS b, unnest(string_split(text, chr(10))) AS block FROM documents WHERE text IS NOT NULL) WHERE trim(block) <> ''),
        cc(doc_id, b, k, part, rest) AS (SELECT doc_id, b, 0, CAST(NULL AS VARCHAR), block FROM cb WHERE NOT {alone.format("block")} AND length(block) > {limit}
            UNION ALL SELECT doc_id, b, k + 1, trim(left(rest, cut)), substr(rest, cut + 1) FROM (SELECT *, CASE WHEN length(rest) <= {limit} THEN length(rest) WHEN instr(left(rest, {limit}), ' ') > 0 AND {limit} - instr(reverse(left(rest, {limit})), ' ') + 1 > {limit // 2} THEN {limit} - instr(reverse(left(rest, {limit})), ' ') + 1 ELSE {limit} END AS cut FROM cc WHERE rest <> '') t),
        cp AS (SELECT doc_id, b, 0 AS k, block AS part, {alone.format("block")} AS alone FROM cb WHERE {alone.format("block")} OR length(block) <= {limit} UNION ALL SELECT doc_id, b, k, part, false FROM cc WHERE part <> ''),
        cs AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY b, k) AS seq, sum(CAST(alone AS INT)) OVER (PARTITION BY doc_id ORDER BY b, k ROWS UNBOUNDED PRECEDING) AS run FROM cp),
        cr AS (SELECT doc_id, min(seq) AS seq, list_reduce(list(part ORDER BY seq), lambda acc, x: CASE WHEN length(string_split(acc, chr(29))[-1]) + length(x) + 2 <= {limit} THEN acc || chr(10) || chr(10) || x ELSE acc || chr(29) || x END) AS text FROM cs WHERE NOT alone GROUP BY doc_id, run UNION ALL SELECT doc_id, seq, part FROM cs WHERE alone),
        cu AS (SELECT doc_id, seq, unnest(generate_series(1, len(string_split(text, chr(29))))) AS sub, unnest(string_split(text, chr(29))) AS text FROM cr),
        chunked AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq, sub) - 1 AS idx, CASE WHEN regexp_matches(text, '^#{{1,6}} ') THEN 'heading' WHEN starts_with(text, '|') THEN 'table' ELSE 'paragraph' END AS kind, text FROM cu)"""


@query("T9", "documents", sql=f"WITH RECURSIVE {chunk_sql(CHUNK)} SELECT doc_id, idx, kind, text FROM chunked")
def t9(documents):
    return chunks(documents.select("doc_id", "text")).withColumn("idx", F.col("idx").cast("long"))


@query("T10", "documents", sql="""
    WITH p AS (SELECT doc_id, text, unnest(generate_series(0, (length(text) - 1) // 1200)) AS idx FROM documents WHERE length(text) > 0)
    SELECT doc_id, idx AS idx, substr(text, idx * 1200 + 1, 1200) AS text FROM p""")
def t10(documents):
    """Hard cuts every 1200 characters."""
    n = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / CHUNK).cast("long"))
    p = documents.where("length(text) > 0").select("doc_id", "text", F.explode(n).alias("idx"))
    return p.select("doc_id", "idx", F.expr(f"substring(text, cast(idx * {CHUNK} + 1 as int), {CHUNK})").alias("text"))


@query("T11", "documents", sql=f"WITH RECURSIVE {chunk_sql(LARGE)} SELECT doc_id, count(*) AS chunks, max(length(text))::BIGINT AS longest FROM chunked GROUP BY 1")
def t11(documents):
    return chunks(documents.select("doc_id", "text"), LARGE).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.length("text")).cast("long").alias("longest"))


def junk(text: Column) -> Column:
    alnum = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")) / F.length(text)
    cjk = F.length(F.regexp_replace(text, r"[^\x{4E00}-\x{9FFF}]", "")) / F.length(text)
    return text.rlike(PDF_MARKS) | (F.length(F.trim(text)) < 3) | (cjk > 0.3) | (alnum < 0.3)


@query("T12", "lines", sql=f"""
    SELECT doc_id, count(*) FILTER (WHERE regexp_matches(line, '{PDF_MARKS}') OR length(trim(line)) < 3 OR length(regexp_replace(line, '[^\\x{{4E00}}-\\x{{9FFF}}]', '', 'g')) / length(line) > 0.3 OR length(regexp_replace(line, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / length(line) < 0.3) AS junk, count(*) AS lines
    FROM lines WHERE line <> '' GROUP BY 1""")
def t12(lines):
    return lines.where("line <> ''").groupBy("doc_id").agg(F.count(F.when(junk(F.col("line")), 1)).alias("junk"), F.count("*").alias("lines"))


@query("T13_words", "documents", sql=f"""
    WITH s(lang, w) AS ({", ".join([f"VALUES {', '.join(chr(40) + repr(k) + ',' + repr(w) + chr(41) for k, ws in STOP.items() for w in ws)}"])}),
         t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}]+')) AS w FROM documents), c AS (SELECT doc_id, s.lang, count(*) AS n FROM t JOIN s USING (w) GROUP BY 1, 2),
         r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, lang) AS k FROM c)
    SELECT doc_id, lang AS detected, n AS words FROM r WHERE k = 1""")
def t13_words(spark, documents):
    """Language by stop words."""
    s = spark.createDataFrame([(k, w) for k, ws in STOP.items() for w in ws], "detected string, w string")
    t = documents.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0))).alias("w"))
    c = t.join(F.broadcast(s), "w").groupBy("doc_id", "detected").agg(F.count("*").alias("words"))
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("words"), "detected"))
    return c.withColumn("k", best).where("k = 1").select("doc_id", "detected", "words")


@query("T14", "conversations", sql="""
    WITH c AS (SELECT conv_id, turn, len(regexp_extract_all(text, '[\\x{0400}-\\x{04FF}]')) AS cy, len(regexp_extract_all(text, '[A-Za-z]')) AS la FROM conversations)
    SELECT conv_id, turn, CASE WHEN cy >= 3 AND cy >= la THEN 'ru' WHEN la >= 3 THEN 'en' ELSE 'unknown' END AS reply FROM c""")
def t14(conversations):
    """Reply language by the majority of letters."""
    cy, la = F.regexp_count("text", F.lit(r"[\x{0400}-\x{04FF}]")), F.regexp_count("text", F.lit("[A-Za-z]"))
    return conversations.select("conv_id", "turn", F.when((cy >= 3) & (cy >= la), "ru").when(la >= 3, "en").otherwise("unknown").alias("reply"))


@query("T15", "documents", "labels", sql="SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE length(text) < 20 OR coalesce(quality, 1) <> 0")
def t15(documents, labels):
    """Chunks kept by their verdicts; short ones and those without a verdict stay."""
    junk_ids = labels.where("quality = 0").select("doc_id")
    long = documents.where("length(text) >= 20").join(junk_ids, "doc_id", "left_semi").select("doc_id")
    return without(documents, long)


def without(documents: DataFrame, gone: DataFrame) -> DataFrame:
    return documents.join(gone, "doc_id", "left_anti").select("doc_id")


@query("T16", "lines", "registry", sql="""
    SELECT doc_id, CASE WHEN starts_with(min(file_name), '#') THEN '' ELSE '# ' || min(file_name) || chr(10) || chr(10) END || string_agg(line, chr(10) || chr(10) ORDER BY pos) AS markdown
    FROM lines JOIN registry ON id = doc_id WHERE length(trim(line)) >= 3 GROUP BY doc_id""")
def t16(lines, registry):
    """Markdown of the useful lines, with a title."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "line")))
    body = lines.where("length(trim(line)) >= 3").groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n\n").alias("body"))
    named = body.join(registry.select("id", "file_name"), F.col("doc_id") == F.col("id"))
    title = F.when(F.col("file_name").startswith("#"), "").otherwise(F.concat(F.lit("# "), "file_name", F.lit("\n\n")))
    return named.select("doc_id", F.concat(title, "body").alias("markdown"))


@query("T17", "lines", sql="SELECT doc_id, string_agg('<!-- p:' || CAST(pos AS VARCHAR) || ':' || CASE WHEN starts_with(line, '#') THEN 'heading' ELSE 'paragraph' END || ' -->' || chr(10) || line, chr(10) ORDER BY pos) AS marked FROM lines WHERE line <> '' GROUP BY 1")
def t17(lines):
    """Blocks with markers of their number and kind."""
    mark = F.concat(F.lit("<!-- p:"), F.col("pos").cast("string"), F.lit(":"), F.when(F.col("line").startswith("#"), "heading").otherwise("paragraph"), F.lit(" -->\n"), "line")
    parts = F.array_sort(F.collect_list(F.struct("pos", mark.alias("m"))))
    return lines.where("line <> ''").groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["m"]), "\n").alias("marked"))


@query("T18", "nodes", sql="""
    WITH r AS (SELECT document_id, label, id, left(coalesce(name, id), 200) AS shown, row_number() OVER (PARTITION BY document_id, label ORDER BY id) AS k FROM (SELECT DISTINCT document_id, label, id, name FROM nodes))
    SELECT document_id, label, string_agg('- ' || shown, chr(10) ORDER BY k) AS catalogue FROM r WHERE k <= 6 GROUP BY 1, 2""")
def t18(nodes):
    """The catalogue of a document's nodes: six of each label."""
    d = nodes.select("document_id", "label", "id", "name").distinct()
    k = F.row_number().over(Window.partitionBy("document_id", "label").orderBy("id"))
    r = d.withColumn("k", k).where("k <= 6").withColumn("shown", F.concat(F.lit("- "), F.substring(F.coalesce("name", "id"), 1, 200)))
    parts = F.array_sort(F.collect_list(F.struct("k", "shown")))
    return r.groupBy("document_id", "label").agg(F.array_join(F.transform(parts, lambda x: x["shown"]), "\n").alias("catalogue"))


def tokens(text: Column) -> Column:
    """Distinct lower-case words of two characters or more, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda t: F.length(t) >= 2)))


@query("T19", "documents", sql="SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda t: length(t) >= 2))), ' ') AS tokens FROM documents WHERE text IS NOT NULL")
def t19(documents):
    return documents.where("text IS NOT NULL").select("doc_id", F.array_join(tokens(F.col("text")), " ").alias("tokens"))


@query("T20", "nodes", sql="SELECT document_id, id, left(coalesce(nullif(trim(name), ''), nullif(trim(parameter), ''), nullif(trim(unit), ''), id), 120) AS shown FROM nodes")
def t20(nodes):
    """The first non-empty of several fields."""
    first = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("name", "parameter", "unit")], "id")
    return nodes.select("document_id", "id", F.substring(first, 1, 120).alias("shown"))


def compact(text: Column, n: int) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > n, F.concat(F.rtrim(F.substring(flat, 1, n - 1)), F.lit("…"))).otherwise(flat)


@query("T21", "documents", sql="WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 200 THEN rtrim(left(t, 199)) || '…' ELSE t END AS text FROM f")
def t21(documents):
    return documents.select("doc_id", compact(F.col("text"), 200).alias("text"))


@query("T22", "conversations", sql="SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '\\[?(doc|node|chunk)_?id[:=]\\s*\\S+\\]?', '', 'g'), '\\s{2,}', ' ', 'g')) AS text FROM conversations")
def t22(conversations):
    """Answer text without internal ids."""
    return conversations.select("conv_id", "turn", F.trim(F.regexp_replace(F.regexp_replace("text", r"\[?(doc|node|chunk)_?id[:=]\s*\S+\]?", ""), r"\s{2,}", " ")).alias("text"))


@query("T24", "conversations", sql="WITH f AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations) SELECT conv_id, turn, CASE WHEN length(t) <= 55 THEN t ELSE coalesce(nullif(regexp_extract(t, '^(.{1,55})\\s', 1), ''), left(t, 55)) || '…' END AS title FROM f")
def t24(conversations):
    """Thread titles of at most 55 characters, cut at a word's end."""
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    cut = F.coalesce(F.nullif(F.regexp_extract(flat, r"^(.{1,55})\s", 1), F.lit("")), F.substring(flat, 1, 55))
    return conversations.select("conv_id", "turn", F.when(F.length(flat) <= 55, flat).otherwise(F.concat(cut, F.lit("…"))).alias("title"))


@query("T25", "part", sql="SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS slug, substr(md5(p_name), 1, 12) AS short_hash, ('0x' || substr(md5(p_name), 1, 15))::BIGINT AS point_id FROM part")
def t25(part):
    """Slugs, short hashes and 60-bit point ids."""
    return part.select("p_partkey", F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "-").alias("slug"), F.substring(F.md5("p_name"), 1, 12).alias("short_hash"), F.conv(F.substring(F.md5("p_name"), 1, 15), 16, 10).cast("long").alias("point_id"))
