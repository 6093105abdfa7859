"""Users, campaigns, members, sessions and their upkeep, as merges and listings of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DEFAULT_NAME = "Player"
#: The stage (from 0) in which each status stands, whom a status waits for, and what works by itself.
STAGES = {
    "uploaded": 0, "recorded": 0, "transcribing": 1, "transcribed": 1, "refining": 2, "refined": 2, "identifying_speakers": 3, "speakers_identified": 3, "speaker_pending": 3, "attributing": 3, "attribution_ready": 3, "attribution_review": 3,
    "summarizing": 4, "summary_ready": 4, "generating_wiki": 5, "wiki_plan_ready": 5, "applying_wiki": 5, "content_ready": 5, "reviewed": 5, "published": 5, "failed": 0,
}
NEEDS_DM = ["speaker_pending", "attribution_review", "summary_ready", "wiki_plan_ready"]
WORKING = ["transcribing", "refining", "identifying_speakers", "attributing", "summarizing", "generating_wiki", "applying_wiki"]
#: How a plan may go on.
PLAN_MOVES = {"confirm": ("draft", "applying"), "applied": ("applying", "applied"), "fail": ("applying", "draft"), "regenerate": ("applied", "draft")}


def stage(status: Column) -> Column:
    """Of an unknown status 0."""
    known = F.create_map(*[F.lit(x) for pair in STAGES.items() for x in pair])
    return F.coalesce(F.element_at(known, status), F.lit(0))


def display_name(*claims: Column) -> Column:
    """The first claim that isn't null or empty."""
    return F.coalesce(*[F.when(c != "", c) for c in claims], F.lit(DEFAULT_NAME))


def bucket_and_key(uri: Column) -> Column:
    """Before and after the first slash; without one the key is empty."""
    at = F.instr(uri, "/")
    return F.struct(F.when(at > 0, F.substring(uri, F.lit(1), at - 1)).otherwise(uri).alias("bucket"), F.when(at > 0, F.substring(uri, at + 1, F.length(uri))).otherwise("").alias("key"))


def campaigns_of_users(members: DataFrame, campaigns: DataFrame) -> DataFrame:
    """user, campaign, title, role, place: a user's campaigns by when they joined."""
    place = F.row_number().over(Window.partitionBy("user").orderBy("joined", "campaign"))
    return members.join(campaigns, "campaign").withColumn("place", place).select("user", "campaign", "title", "role", "place")


def session_order(sessions: DataFrame) -> DataFrame:
    """place of each session in its campaign: newest recording first, those without a date last, then the newest row."""
    w = Window.partitionBy("campaign").orderBy(F.col("recorded").desc_nulls_last(), F.col("created").desc())
    return sessions.withColumn("place", F.row_number().over(w))


def closed_stages(labels: DataFrame) -> DataFrame:
    """(session_id, labels) of the sessions none of whose labels is unconfirmed: these go on."""
    return labels.groupBy("session_id").agg(F.count(F.lit(1)).alias("labels"), F.count_if(F.coalesce(F.col("status"), F.lit("")) != "confirmed").alias("open")).filter("open = 0").select("session_id", "labels")


def provision(logins: DataFrame, users: DataFrame) -> DataFrame:
    """Who a login (login, subject, email) is: known by subject, else linked by e-mail whatever its case, else a new user.

    login, user (null for a new one), outcome. Of users that share an e-mail the smallest id.
    """
    by_subject = logins.join(users.select("subject", F.col("id").alias("a")), "subject", "left")
    mails = users.groupBy(F.lower("email").alias("mail")).agg(F.min("id").alias("b"))
    found = by_subject.join(mails, F.lower("email") == F.col("mail"), "left").groupBy("login").agg(F.min("a").alias("a"), F.min("b").alias("b"))
    outcome = F.when(F.col("a").isNotNull(), "known").when(F.col("b").isNotNull(), "linked").otherwise("created")
    return found.select("login", F.coalesce("a", "b").alias("user"), outcome.alias("outcome"))


def latest_profiles(enrolments: DataFrame) -> DataFrame:
    """One profile per (user, campaign): a new enrolment replaces the one before."""
    last = F.max_by(F.struct("sample", "at"), F.struct("at", "enrolment"))
    return enrolments.groupBy("user", "campaign").agg(last.alias("p"), F.count(F.lit(1)).alias("enrolments")).select("user", "campaign", "p.sample", "p.at", "enrolments")


def upsert_members(members: DataFrame, changes: DataFrame) -> DataFrame:
    """Members (campaign, user, role, name) after changes (change, action add, update or remove, ...); the last of a member counts.

    An add of a member that is there and an update of one that isn't do nothing; an
    update keeps what it leaves null. outcome: kept, added, updated, removed.
    """
    last = changes.groupBy("campaign", "user").agg(F.max_by(F.struct("action", F.col("role").alias("new_role"), F.col("name").alias("new_name")), "change").alias("c"))
    both = members.withColumn("here", F.lit(True)).join(last, ["campaign", "user"], "full")
    here = F.coalesce("here", F.lit(False))
    outcome = F.when(here & (F.col("c.action") == "remove"), "removed").when(here & (F.col("c.action") == "update"), "updated").when(here, "kept").when(F.col("c.action") == "add", "added")
    changed = outcome.isin("updated", "added")
    pick = lambda new, old: F.when(changed, F.coalesce(F.col(f"c.{new}"), F.col(old))).otherwise(F.col(old)).alias(old)
    return both.select("campaign", "user", pick("new_role", "role"), pick("new_name", "name"), outcome.alias("outcome")).filter("outcome IS NOT NULL")


def new_campaigns(wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Campaigns (campaign, title, slug) from wanted (campaign, title, base, owner), with slugs of their own, and the owners as members with the role of dm."""
    from colloquy.operators.wiki import unique_slugs

    slugs = unique_slugs(wanted.select(F.lit("all").alias("scope"), F.col("campaign").alias("id"), "base"))
    rows = wanted.join(slugs.select(F.col("id").alias("campaign"), "slug"), "campaign").select("campaign", "title", "slug")
    return rows, wanted.select("campaign", F.col("owner").alias("user"), F.lit("dm").alias("role"))


def revisions(edits: DataFrame) -> DataFrame:
    """A summary's history: every save or revision (session_id, edit, kind) has the number of its revision; a revision clears the conflicts found before it.

    session_id, edit, revision, conflicts: those open after the edit.
    """
    w = Window.partitionBy("session_id").orderBy("edit")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    number = F.sum((F.col("kind") == "revise").cast("int")).over(upto)
    staged = edits.withColumn("revision", number)
    open_ = F.sum(F.when(F.col("kind") == "revise", 0).otherwise(F.col("found"))).over(Window.partitionBy("session_id", "revision").orderBy("edit").rowsBetween(Window.unboundedPreceding, 0))
    return staged.select("session_id", "edit", "revision", open_.alias("conflicts"))


def requested_rows(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows that lists of ids (list, ids) ask for, each once, in the order of the list; unknown ids are left out."""
    wanted = requests.select("list", F.posexplode("ids").alias("pos", "id")).groupBy("list", "id").agg(F.min("pos").alias("pos"))
    found = wanted.join(rows, "id")
    return found.withColumn("place", F.row_number().over(Window.partitionBy("list").orderBy("pos"))).drop("pos")


def plan_status(moves: DataFrame) -> DataFrame:
    """Plans (plan) after their moves (at, move) in order: plan, status, applied, refused. A plan starts as a draft."""
    of = F.create_map(*[F.lit(x) for m, (a, b) in PLAN_MOVES.items() for x in (f"{a}>{m}", b)])
    start = F.struct(F.lit("draft").alias("status"), F.lit(0).alias("applied"), F.lit(0).alias("refused"))

    def step(s: Column, m: Column) -> Column:
        to = F.element_at(of, F.concat(s["status"], F.lit(">"), m["move"]))
        return F.struct(F.coalesce(to, s["status"]).alias("status"), (s["applied"] + F.coalesce((to == "applied").cast("int"), F.lit(0))).alias("applied"), (s["refused"] + to.isNull().cast("int")).alias("refused"))

    ordered = moves.groupBy("plan").agg(F.array_sort(F.collect_list(F.struct("at", "move"))).alias("m"))
    return ordered.select("plan", F.aggregate("m", start, step).alias("s")).select("plan", "s.*")


def relation_outcomes(wanted: DataFrame, pages: DataFrame, existing: DataFrame) -> DataFrame:
    """What becomes of relations (relation, page, related, type): missing, self, cross_campaign, duplicate or created.

    Of equal ones in one request the first is created.
    """
    side = lambda c: pages.select(F.col("id").alias(c), F.col("campaign").alias(f"{c}_campaign"))
    known = existing.select("page", "related", "type", F.lit(True).alias("known")).distinct()
    rows = wanted.join(side("page"), "page", "left").join(side("related"), "related", "left").join(known, ["page", "related", "type"], "left")
    again = F.row_number().over(Window.partitionBy("page", "related", "type").orderBy("relation")) > 1
    a, b = F.col("page_campaign"), F.col("related_campaign")
    outcome = F.when(a.isNull() | b.isNull(), "missing").when(F.col("page") == F.col("related"), "self").when(a != b, "cross_campaign").when(F.col("known").isNotNull() | again, "duplicate").otherwise("created")
    return rows.select("relation", "page", "related", "type", outcome.alias("outcome"))


def guarded_delete(sessions: DataFrame, wanted: DataFrame, children: dict[str, DataFrame], deletable: Column) -> tuple[DataFrame, DataFrame]:
    """(sessions with outcome deleted, refused or kept, rows left and gone per table) of a cascade from sessions that may be deleted."""
    asked = wanted.select("session_id", F.lit(True).alias("asked")).distinct()
    out = sessions.join(asked, "session_id", "left").withColumn("outcome", F.when(F.col("asked").isNull(), "kept").when(deletable, "deleted").otherwise("refused")).drop("asked")
    gone = out.filter("outcome = 'deleted'").select("session_id")
    counts = [rows.join(gone.withColumn("gone", F.lit(1)), "session_id", "left").agg(F.lit(name).alias("table"), F.count("gone").alias("deleted"), F.count_if(F.col("gone").isNull()).alias("left")) for name, rows in children.items()]
    report = counts[0]
    for c in counts[1:]:
        report = report.union(c)
    return out, report


def session_report(pages: DataFrame, timeline: DataFrame) -> DataFrame:
    """Per session its pages, how many are published, and its timeline entries in order of their date."""
    own = pages.groupBy("session_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("status") == "published").alias("published"))
    entries = timeline.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "entry"))), lambda x: x["entry"]).alias("entries"))
    none = F.array().cast(entries.schema["entries"].dataType)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return own.join(entries, "session_id", "full").select("session_id", zero("pages"), zero("published"), F.coalesce("entries", none).alias("entries"))


def roster(members: DataFrame, chars: int = 200) -> DataFrame:
    """Who plays whom, from members (campaign, role, player, character, description): rows of kind dm (name) or player (name, character), descriptions on one line and cut.

    A player without a character and a row without a name say nothing.
    """
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    rows = members.select("campaign", F.lower(clean(F.col("role"))).alias("role"), clean(F.col("player")).alias("name"), clean(F.col("character")).alias("character"), F.substring(F.trim(F.regexp_replace(F.coalesce("description", F.lit("")), r"\s+", " ")), 1, chars).alias("description"))
    kind = F.when(F.col("role") == "dm", "dm").otherwise("player")
    return rows.filter("name <> '' AND (role = 'dm' OR character <> '')").select("campaign", kind.alias("kind"), "name", F.when(kind == "player", F.col("character")).otherwise("").alias("character"), "description").distinct()


def speaker_map(events: DataFrame) -> DataFrame:
    """(session_id, label, user, name, character) from events (session_id, at, type, speakers); the last event that names a label counts.

    speakers is an array of structs (label, user, name, character); entries with
    neither user nor name say nothing. speakers.assigned counts for its first one only.
    """
    mine = F.when(F.col("type") == "speakers.identified", F.col("speakers")).when(F.col("type") == "speakers.assigned", F.slice("speakers", 1, 1))
    rows = events.select("session_id", "at", F.explode(mine).alias("s")).select("session_id", "at", "s.*").filter("label <> '' AND (user IS NOT NULL OR name IS NOT NULL)")
    return rows.groupBy("session_id", "label").agg(F.max_by(F.struct("user", "name", "character"), "at").alias("s")).select("session_id", "label", "s.*")


def page_history(actions: DataFrame) -> DataFrame:
    """The state of pages after their actions (page, at, action create, update, approve, archive, show or hide; title): page, title, status, visibility, versions.

    A create or update that brings a title is a version; an archived page stays archived.
    """
    some = lambda *names: F.col("action").isin(*names)
    return actions.groupBy("page").agg(
        F.max_by("title", F.when(some("create", "update") & F.col("title").isNotNull(), F.col("at"))).alias("title"),
        F.when(F.max(some("archive")), "archived").when(F.max(some("approve")), "published").otherwise("draft").alias("status"),
        F.coalesce(F.max_by(F.when(some("hide"), "dm_only").otherwise("public"), F.when(some("show", "hide"), F.col("at"))), F.lit("public")).alias("visibility"),
        F.count_if(some("create", "update") & F.col("title").isNotNull()).alias("versions"),
    )


def visible_timeline(entries: DataFrame, role: str) -> DataFrame:
    """A player sees approved entries only; place by date, those without one last, then by number."""
    shown = entries if role == "dm" else entries.filter("approved")
    return shown.withColumn("place", F.row_number().over(Window.partitionBy("campaign").orderBy(F.col("date").asc_nulls_last(), "entry")))


def replace_projection(stored: DataFrame, incoming: DataFrame, scope: str, key: str, value: str) -> DataFrame:
    """Within the scopes that incoming has, its rows replace all stored ones; other scopes stay. outcome: kept, inserted, updated, unchanged, deleted."""
    touched = incoming.select(scope).distinct().withColumn("touched", F.lit(True))
    both = stored.select(scope, key, F.col(value).alias("old"), F.lit(True).alias("was")).join(incoming.select(scope, key, F.col(value).alias("new"), F.lit(True).alias("now")), [scope, key], "full").join(touched, scope, "left")
    outcome = F.when(F.col("touched").isNull(), "kept").when(F.col("now").isNull(), "deleted").when(F.col("was").isNull(), "inserted").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("updated")
    return both.select(scope, key, F.when(F.col("now").isNotNull(), F.col("new")).otherwise(F.col("old")).alias(value), outcome.alias("outcome"))


def reset_campaigns(pages: DataFrame, timeline: DataFrame, campaigns: DataFrame) -> DataFrame:
    """(table, id, campaign) of the pages (id, campaign) and timeline entries of campaigns that are reset: what is deleted, and for pages taken out of the index."""
    gone = campaigns.select("campaign").distinct()
    of = lambda df, name: df.join(gone, "campaign", "left_semi").select(F.lit(name).alias("table"), "id", "campaign")
    return of(pages, "pages").union(of(timeline, "timeline"))


def reload_questions(stored: DataFrame, moments: DataFrame, kinds: list[str]) -> DataFrame:
    """(session_id, question, kind, refs): stored questions (session_id, question, kind, utterances) of kinds still asked, with the references of their utterances (session_id, utterance, ref) in order; those of which none is left go."""
    targets = stored.filter(F.col("kind").isin(*kinds)).select("session_id", "question", "kind", F.posexplode("utterances").alias("pos", "utterance"))
    rows = targets.join(moments, ["session_id", "utterance"])
    return rows.groupBy("session_id", "question", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref"))), lambda x: x["ref"]).alias("refs"))


def gated_participants(events: DataFrame, statuses: DataFrame, confident: list[str]) -> DataFrame:
    """events (event, participants, refs) whose participants stay only if all references are confident; raw labels never do."""
    from colloquy.functions.text import is_raw_label
    from colloquy.operators.wiki import gate

    verdicts = gate(events.select(F.col("event").alias("fact"), "refs"), statuses, confident).select(F.col("fact").alias("event"), "verdict")
    named = F.filter("participants", lambda p: ~is_raw_label(p))
    return events.join(verdicts, "event").select("event", F.when(F.col("verdict") == "kept", named).otherwise(F.array().cast("array<string>")).alias("participants"))
