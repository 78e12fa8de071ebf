"""Fixture views over the driver's tables (see FIXTURES.md section B).

The same frames are written as DuckDB SQL in ``feedloom.plans.oracle`` so each
operator has an independent oracle. Every view reads whole tables and only
the columns it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.ids import assign_ids


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _tech(event_id):
    return F.split(F.when(event_id % 3 == 0, F.lit("unknown")).otherwise(F.lit("typescript,fastify")), ",")


def _skill(n):
    return F.concat(F.lit("skill-"), F.lpad(n.cast("string"), 2, "0"))


def fx_invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") != "error")
    return ev.select(
        (F.col("event_id") + 1).alias("id"),
        _skill(5 + F.col("user_id") % 23).alias("skill_name"),
        F.concat(F.lit("/repo/"), F.col("event_type")).alias("working_directory"),
        _tech(F.col("event_id")).alias("tech_stack"),
        F.col("ts").cast("timestamp_ntz").alias("started_at"),
        F.lit(None).cast("timestamp_ntz").alias("finished_at"),
        F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "signup", "failed")
        .otherwise("unknown").alias("status"),
    )


def fx_corrections_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corrections without ids, for queries that use none."""
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    return ev.select(_skill(F.col("user_id") % 20).alias("skill_name"), F.col("ts").cast("timestamp_ntz").alias("created_at"))


def fx_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the key is numbered; the other columns are joined to it, so filters on them and unused columns
    reach the scan."""
    ev = (table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
          .select("event_id", "user_id", "props", "ts"))
    ev = ev.join(assign_ids(ev.select("event_id"), ["event_id"]), "event_id")
    k = F.col("event_id") * 37 % 101
    return ev.select(
        "id",
        _skill(F.col("user_id") % 20).alias("skill_name"),
        F.lit("/repo/project").alias("working_directory"),
        _tech(F.col("event_id")).alias("tech_stack"),
        F.col("props").alias("ai_output"),
        F.concat(F.lit('fix, "'), F.col("event_id").cast("string"), F.lit('"')).alias("user_correction_input"),
        (k.cast("double") / 100).alias("classification_confidence"),
        k.between(60, 79).alias("needs_batch_review"),
        F.col("ts").cast("timestamp_ntz").alias("created_at"),
    )


def fx_turn_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def fx_upgrade_posts(spark: SparkSession, sf_dir: str, start_mod: int = 150, width_mod: int = 40) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    k = F.col("o_orderkey")
    typ = F.when(k % 4 == 0, F.lit("major")).otherwise(F.lit("minor"))
    start = 1 + k * 7 % start_mod
    end = start + k % width_mod
    opened = F.col("o_orderdate").cast("timestamp_ntz")
    return o.select(
        k.alias("arrival"),
        F.concat(F.lit("https://example.com/mr/"), (k % 97).cast("string")).alias("mr_url"),
        F.concat(F.lit("[skills-feedback]["), typ, F.lit("][feedback:"), start.cast("string"), F.lit("-"),
                 end.cast("string"), F.lit("] skill updates")).alias("title"),
        F.concat(F.lit("hash"), k.cast("string")).alias("head_commit_hash"),
        typ.alias("iteration_type"),
        start.cast("long").alias("feedback_id_start"),
        end.cast("long").alias("feedback_id_end"),
        F.when(F.col("o_orderstatus") == "F", "merged").when(F.col("o_orderstatus") == "P", "closed")
        .otherwise("open").alias("status"),
        opened.alias("opened_at"),
        F.when(F.col("o_orderstatus") == "F", opened + F.expr("INTERVAL 1 DAY")).alias("merged_at"),
    )


def fx_status_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status changes for MR ids: every open order asks to mark MR ``o_orderkey + 1`` merged
    three days after it opened; ids that name no MR are error rows."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return o.filter(F.col("o_orderstatus") == "O").select(
        F.col("o_orderkey").alias("arrival"),
        (F.col("o_orderkey") + 1).alias("id"),
        F.lit("merged").alias("status"),
        (F.col("o_orderdate").cast("timestamp_ntz") + F.expr("INTERVAL 3 DAYS")).alias("merged_at"),
    )


def fx_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    k = F.col("n_nationkey")
    return n.select(
        F.concat(F.lit("scope-"), k.cast("string")).alias("feedback_scope"),
        F.concat(F.lit("http://feedback"), k.cast("string"), F.lit(".dev.lan:4321")).alias("feedback_server_url"),
        F.split(F.concat(_skill(k % 20), F.lit(",skill-"), F.lpad((20 + k % 8).cast("string"), 2, "0")), ",")
        .alias("reportable_skills"),
    )


def fx_scopes_with_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fx_scopes`` plus one damaged copy of every nation row (a different defect by key % 6)."""
    good = fx_scopes(spark, sf_dir)
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    k = F.col("n_nationkey")
    d = k % 6
    base_url = F.concat(F.lit("http://feedback"), k.cast("string"), F.lit(".dev.lan:4321"))
    broken = n.select(
        F.when(d == 0, F.concat(F.lit("bad_scope_"), k.cast("string")))
        .otherwise(F.concat(F.lit("broken-"), k.cast("string"))).alias("feedback_scope"),
        F.when(d == 1, F.lit("http://0.0.0.0:4321"))
        .when(d == 2, F.concat(base_url, F.lit("/?token=bad")))
        .when(d == 3, F.concat(base_url, F.lit("/#section")))
        .when(d == 4, F.concat(F.lit("ftp://feedback"), k.cast("string"), F.lit(".dev.lan")))
        .otherwise(F.concat(F.lit("HTTP://Feedback"), k.cast("string"), F.lit(".DEV.lan:80/"))).alias(
            "feedback_server_url"),
        F.when(d == 5, F.array(F.lit(" skill-01 "), F.lit("feedback-rules-x"), F.lit("skill-01")))
        .when(d == 4, F.array(F.lit(" "), F.lit("")))
        .otherwise(F.array(_skill(k % 20), _skill(k % 20))).alias("reportable_skills"),
    )
    return good.unionByName(broken)


def fx_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    k = F.col("n_nationkey")
    return n.select(
        F.concat(F.lit("scope-"), k.cast("string")).alias("scope"),
        F.when(k % 3 != 0, F.concat(F.lit("hash"), k.cast("string"))).alias("head_commit_hash"),
    )


def fx_raw_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    i = F.col("event_id")
    pad2 = lambda c: F.lpad(c.cast("string"), 2, "0")
    skill = (F.when(i % 17 == 0, F.lit('""')).when(i % 19 == 0, F.lit('"feedback-rules-zeta"'))
             .when(i % 23 == 0, F.lit("123"))
             .otherwise(F.concat(F.lit('"skill-'), (F.col("user_id") % 20).cast("string"), F.lit('"'))))
    tech = (F.when(i % 11 == 0, F.lit('"typescript"')).when(i % 7 == 0, F.lit("[]"))
            .otherwise(F.lit('["typescript","fastify"]')))
    conf = (F.when(i % 13 == 0, F.lit("1.5")).when(i % 29 == 0, F.lit('"0.9"'))
            .otherwise(F.concat(F.lit("0."), pad2(i * 37 % 100))))
    payload = F.concat(
        F.lit('{"skill_name":'), skill,
        F.lit(',"working_directory":"/repo/project","tech_stack":'), tech,
        F.lit(',"ai_output":"wrong","user_correction_input":"no","classification_confidence":'), conf,
        F.lit(',"needs_batch_review":false,"extra":1,"created_at":"2024-01-'), pad2(1 + i % 28), F.lit("T"),
        pad2(i % 24), F.lit(":00:00"), F.when(i % 31 == 0, F.lit("+08:00")).otherwise(F.lit(".000Z")), F.lit('"}'))
    return e.select(i.alias("arrival"), payload.alias("payload"))


def fx_wide_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closed id range per order: to the largest valid id, over many blocks, or short."""
    k = F.col("o_orderkey")
    start = 1 + k * 7 % 5000
    end = F.when(k % 5 == 0, F.lit((1 << 53) - 1)).when(k % 5 == 1, start + 100_000).otherwise(start + k % 400)
    return table(spark, sf_dir, "orders").select(k.alias("id"), start.cast("long").alias("feedback_id_start"),
                                                 end.cast("long").alias("feedback_id_end"))


def fx_wide_mrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An MR per order with a range of its own: short (gaps stay between them below id 1500), over many blocks, or to the
    largest valid id."""
    k = F.col("o_orderkey")
    typ = F.when(k % 2 == 0, F.lit("major")).otherwise(F.lit("minor"))
    short = 1 + k * 7 % 50 * 100
    start = F.when(k % 20 < 2, 1500 + k * 7 % 5000).otherwise(short)
    end = F.when(k % 20 == 0, F.lit((1 << 53) - 1)).when(k % 20 == 1, start + 100_000).otherwise(start + k % 60)
    opened = F.col("o_orderdate").cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate").select(
        (k + 1).alias("id"), F.concat(F.lit("https://example.com/wide/"), k.cast("string")).alias("mr_url"),
        F.concat(F.lit("[skills-feedback]["), typ, F.lit("][feedback:"), start.cast("string"), F.lit("-"), end.cast("string"),
                 F.lit("] skill updates")).alias("title"),
        F.concat(F.lit("hash"), k.cast("string")).alias("head_commit_hash"), typ.alias("iteration_type"),
        start.cast("long").alias("feedback_id_start"), end.cast("long").alias("feedback_id_end"),
        F.when(F.col("o_orderstatus") == "F", "merged").otherwise("open").alias("status"), opened.alias("opened_at"),
        F.when(F.col("o_orderstatus") == "F", opened + F.expr("INTERVAL 1 DAY")).alias("merged_at"),
        F.lit(None).cast("timestamp_ntz").alias("purged_at"))


# URL forms with %s for a number.
URL_FORMS = ["http://my_host/x%s", "http://git_lab.internal:3000/mr/%s", "https://h/a b%s", "https://h/x?q={%s}", "https://h/|a%s",
             "https://例子.cn/mr/%s", "HTTP://Ex.com/a/../b/%s/", "http://h:80/./%s", "https://u:p@h:8443/%s#f", "ftp://h/%s", "http://:80/%s",
             "mailto:a%s@b", "http://h:70000/%s", "  https://h/%s\t", "http:h%s", "nothing %s"]


def fx_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    forms = F.array(*[F.lit(u) for u in URL_FORMS])
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), F.replace(F.element_at(forms, (k % len(URL_FORMS) + 1).cast("int")), F.lit("%s"), k.cast("string")).alias("url"))


def fx_skill_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma lists padded with all kinds of white space, empty entries included."""
    k = F.col("o_orderkey")
    pads = F.array(*[F.lit(p) for p in (" ", "\u3000", "\u00a0", "\t\n", "\ufeff", "")])
    pad = F.element_at(pads, (k % 6 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.concat(pad, F.lit("a b"), pad, F.lit(","), pad, F.lit(",技能"), pad, F.lit(","),
                                                                         k.cast("string"), pad).alias("skills"))


def fx_mr_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The post feed (even arrivals) and a status update per order (odd arrivals); some ids name no MR (yet)."""
    posts = fx_upgrade_posts(spark, sf_dir).withColumn("arrival", F.col("arrival") * 2).withColumn("id", F.lit(None).cast("long"))
    k = F.col("o_orderkey")
    updates = table(spark, sf_dir, "orders").select(
        (2 * k + 1).alias("arrival"), (1 + k * 13 % 120).alias("id"), F.when(k % 3 == 0, "closed").otherwise("merged").alias("status"),
        F.when(k % 3 != 0, F.col("o_orderdate").cast("timestamp_ntz")).alias("merged_at"))
    return posts.unionByName(updates, allowMissingColumns=True)


# Payload forms with %s for a number: every check of the three ingest schemas fails in some form.
INVOCATION_FORMS = [
    '{"skill_name":"s%s","working_directory":"/r","tech_stack":["a"],"started_at":"2024-01-05T06:07:08Z","finished_at":null,"status":"success"}',
    '{"skill_name":"s%s","working_directory":"/r","tech_stack":[],"started_at":"2024-01-05T06:07:08Z","finished_at":"2024-01-05T07:00:00.5Z","status":"failed"}',
    '{"skill_name":"s%s","working_directory":"/r","tech_stack":["a"],"started_at":"2024-01-05T06:07:08Z","status":"done"}',
    '{"skill_name":"s%s","working_directory":"/r","tech_stack":["a"],"started_at":"2024-01-05T06:07:08Z","finished_at":"yesterday","status":"unknown"}',
    '{"skill_name":"feedback-rules-%s","working_directory":"/r","tech_stack":["a"],"started_at":"2024-01-05T06:07:08Z","status":"success"}',
    '{"skill_name":"","working_directory":"/r%s","tech_stack":["a"],"started_at":"2024-01-05T06:07:08Z","status":"success"}',
    '{"working_directory":"/r%s","tech_stack":["a"],"started_at":"2024-01-05T06:07:08Z","status":"success"}',
    '{"skill_name":"s%s","working_directory":"/r","tech_stack":["a",""],"started_at":"2024-01-05T06:07:08Z","status":"success"}',
    '[%s]',
    '{"skill_name":"s%s","working_directory":"/r","tech_stack":["a"],"started_at":"2024-01-05T06:07:08+08:00","status":"success"}',
    '{"skill_name":"s%s",',
    '{"skill_name":"s%s","working_directory":null,"tech_stack":["a"],"started_at":"2024-01-05T06:07:08Z","status":5}']
_MR = ('{"mr_url":"https://h/%s","title":"[skills-feedback][major][feedback:%s-%s9] x","head_commit_hash":"h%s","iteration_type":"major",'
       '"feedback_id_start":%s,"feedback_id_end":%s9,"status":"open","opened_at":"2024-01-05T06:07:08Z"}')
MR_FORMS = [
    _MR,
    _MR.replace("major", "minor").replace('"open"', '"merged","merged_at":"2024-01-06T00:00:00Z"'),
    _MR.replace('"feedback_id_start":%s,', '"feedback_id_start":%s99,'),
    _MR.replace('"open"', '"merged"'),
    _MR.replace('"open"', '"open","merged_at":"2024-01-06T00:00:00Z"'),
    _MR.replace("[major]", "[minor]"),
    _MR.replace("[skills-feedback]", "skills"),
    _MR.replace("feedback:%s-%s9", "feedback:%s9-%s"),
    _MR.replace('"feedback_id_start":%s', '"feedback_id_start":0'),
    _MR.replace('"feedback_id_start":%s', '"feedback_id_start":1.5'),
    _MR.replace('"feedback_id_start":%s', '"feedback_id_start":"3"'),
    _MR.replace("https://", "ftp://"),
    _MR.replace('"iteration_type":"major"', '"iteration_type":"huge"').replace('"status":"open",', ""),
    _MR.replace('"feedback_id_end":%s9', '"feedback_id_end":9007199254740992')]
STATUS_FORMS = ['{"status":"merged","merged_at":"2024-01-06T00:00:00Z"}', '{"status":"closed"}', '{"status":"merged"}',
                '{"status":"open","merged_at":null}', '{"status":"open"}', '{"status":"closed"}', '{"status":"done"}', '{"status":"open"}',
                '{"status":"closed","merged_at":"2024-01-06T00:00:00Z"}']


def _forms(forms: list[str], k) -> Column:
    return F.replace(F.element_at(F.array(*[F.lit(x) for x in forms]), (k % len(forms) + 1).cast("int")), F.lit("%s"), k.cast("string"))


def fx_raw_invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") + 1
    return table(spark, sf_dir, "events").select(k.alias("arrival"), _forms(INVOCATION_FORMS, k).alias("payload"))


def fx_raw_mr_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") + 1
    return table(spark, sf_dir, "orders").select(k.alias("arrival"), _forms(MR_FORMS, k).alias("payload"))


def fx_raw_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status updates; forms 4, 5 and 7 ask for ids that are none or name no MR."""
    k = F.col("o_orderkey") + 1
    form = k % len(STATUS_FORMS)
    mr = F.when(form == 4, F.lit(0)).when(form == 5, 1_000_000 + k).when(form != 7, 1 + k % 90)
    return table(spark, sf_dir, "orders").select(k.alias("arrival"), mr.cast("long").alias("id"), _forms(STATUS_FORMS, k).alias("payload"))


BREAK_EVERY = 101  # of the ids, one breaks each constraint


def fx_broken(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The four stored tables with one defect in every 101st row: a NULL in the n-th mandatory column (after the id) where
    id % 101 is n, a failed check from 50 on, a repeated key at 60 and 70, a lost reference at 80."""
    from ..operators.constraints import SCHEMAS

    ev = table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("id"))
    orders = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("id"))
    m = F.col("id") % BREAK_EVERY
    values = {
        "status": F.when(m == 50, "weird").otherwise(F.lit("failed")), "classification_confidence": F.when(m == 51, 1.5).when(m == 52, -0.1).otherwise(0.5),
        "iteration_type": F.when(m == 53, "huge").otherwise(F.lit("major")), "feedback_id_start": F.when(m == 54, F.col("id") + 9).otherwise(F.col("id")),
        "feedback_id_end": F.col("id"), "mr_url": F.when(m == 60, "again").otherwise(F.concat(F.lit("u"), F.col("id").cast("string"))),
        "merge_request_id": F.when(m == 80, -F.col("id")).otherwise(F.col("id"))}
    plain = {"string": F.lit("x"), "bigint": F.lit(1), "array<string>": F.array(F.lit("x")), "boolean": F.lit(True),
             "timestamp_ntz": F.lit("2024-01-05 00:00:00")}
    out = {}
    for name, schema in SCHEMAS.items():
        own = values | ({"status": F.when(m == 50, "weird").otherwise(F.lit("open"))} if name == "merge_requests" else {})
        if name == "purge_audit":
            own = own | {"feedback_id_start": F.lit(1), "feedback_id_end": F.lit(1)}
        cols, n = [F.col("id")], 0
        for f in schema.fields[1:]:
            n += 0 if f.nullable else 1
            col = own.get(f.name, plain.get(f.dataType.simpleString(), F.lit(None)))
            cols.append(F.when((m == n) & F.lit(not f.nullable), F.lit(None)).otherwise(col).cast(f.dataType).alias(f.name))
        rows = (ev if name in ("invocations", "corrections") else orders).select(*cols)
        out[name] = rows.unionByName(rows.filter(m == 70))
    return out


def fx_skill_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, content) of one skill file per source of the documents: its header, then the smallest document id."""
    name = F.when(F.col("source").endswith("3"), F.concat(F.lit("feedback-rules-"), F.col("source"))).otherwise(F.col("source"))
    return (table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("first"))
            .select("source", F.concat(F.lit("---\nname:  "), name, F.lit("\n---\n"), F.col("first").cast("string")).alias("content")))


def fx_long_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as two long ones: turn = conversation * 64 + turn, so buckets begin and end inside, with gaps."""
    c = F.col("conv_id").cast("long")
    return table(spark, sf_dir, "conversations").select((c % 2).alias("conv_id"), (c * 64 + F.col("turn")).alias("turn"), "role", "text")


INSTANT_FORMS = ["2024-01-05T06:07Z", "2024-01-05T06:07:08Z", "2024-01-05T06:07:08.5Z", "2024-01-05T06:07:08.123456789Z", "2024-01-05T06:07:08.000Z"]


def fx_posts_of_many_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = ('{"skill_name":"s%s","working_directory":"/r","tech_stack":["a","b"],"ai_output":"x, y","user_correction_input":"no",'
            '"classification_confidence":0.5,"needs_batch_review":false,"created_at":"')
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(k.alias("arrival"), _forms([form + x + '"}' for x in INSTANT_FORMS], k).alias("payload"))
