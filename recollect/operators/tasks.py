"""Task tracking as an append-only event log with aggregate views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What an event does to a task.
OUTCOME = {"end": "completed", "cancel": "cancelled"}


def task_status(events: DataFrame) -> DataFrame:
    """Current state of every started task.

    ``events``: task_id, agent_id, project_id, seq, at, action (start / end /
    cancel), description. A start (again) makes a task running; the last end or
    cancel after it decides. Ends of unknown tasks have no effect. Everything
    is a partial aggregate, so a task with very many events stays cheap.
    """
    start = F.col("action") == "start"
    closing = F.col("action").isin(*OUTCOME)
    begun = F.struct("seq", "agent_id", "project_id", "description", "at")
    closed = F.struct("seq", "action", "at")
    state = events.groupBy("task_id").agg(
        F.max(F.when(start, begun)).alias("s"), F.max(F.when(closing, closed)).alias("c")
    ).where(F.col("s").isNotNull())
    over = F.coalesce(F.col("c")["seq"] > F.col("s")["seq"], F.lit(False))
    status = F.when(~over, "running").when(F.col("c")["action"] == "end", OUTCOME["end"]).otherwise(OUTCOME["cancel"])
    return state.select(
        "task_id",
        F.col("s")["agent_id"].alias("agent_id"),
        F.col("s")["project_id"].alias("project_id"),
        F.col("s")["description"].alias("description"),
        status.alias("status"),
        F.col("s")["at"].alias("started_at"),
        F.when(over, F.col("c")["at"]).alias("ended_at"),
    )


#: One event of the task log. ``context`` is what the agent was given at the start, ``archive`` and ``stats`` the result of the end.
EVENT = (
    "task_id string, agent_id string, project_id string, seq bigint, at string, action string, description string, "
    "model string, variant string, tags array<string>, context string, archive string, stats map<string,bigint>"
)
PREVIEW = 200


def uncleared(events: DataFrame) -> DataFrame:
    """The events after the last ``clear``, which forgets all tasks and agents before it."""
    last = events.agg(F.max(F.when(F.col("action") == "clear", F.col("seq"))).alias("_cleared"))
    # One row.
    after = events.crossJoin(F.broadcast(last)).where(F.col("_cleared").isNull() | (F.col("seq") > F.col("_cleared")))
    return after.drop("_cleared")


def task_log(events: DataFrame) -> DataFrame:
    """Every field of each task, folded from ``EVENT`` rows.

    A start (again) begins the task anew: running, without result. The last end or
    cancel after it decides the status; the result is that of the last end after it that
    has one. ``clear`` forgets what was before. Ends of unknown tasks and other actions
    have no effect; columns that the log lacks are NULL. Everything is a partial aggregate.
    """
    missing = [f for f in EVENT.split(", ") if f.split()[0] not in events.columns]
    events = uncleared(events.select("*", *[F.lit(None).cast(f.split(" ", 1)[1]).alias(f.split()[0]) for f in missing]))
    action = F.col("action")
    begun = F.struct("seq", "agent_id", "project_id", "description", "model", "variant", "tags", "at", F.substring("context", 1, PREVIEW).alias("preview"))
    # A map has no order, so the row of the greatest number is taken, not the greatest row.
    ended = F.when((action == "end") & F.col("archive").isNotNull(), F.col("seq"))
    state = events.groupBy("task_id").agg(
        F.max_by(begun, F.when(action == "start", F.col("seq"))).alias("s"),
        F.max(F.when(action.isin(*OUTCOME), F.struct("seq", "action", "at"))).alias("c"),
        F.max_by(F.struct("seq", "archive", "stats"), ended).alias("r"),
    ).where(F.col("s").isNotNull())
    over = F.coalesce(F.col("c.seq") > F.col("s.seq"), F.lit(False))
    status = F.when(~over, "running").when(F.col("c.action") == "end", OUTCOME["end"]).otherwise(OUTCOME["cancel"])
    loaded = F.coalesce(F.col("s.preview") != "", F.lit(False))
    return state.select(
        "task_id", "s.agent_id", "s.project_id", "s.description", "s.model", "s.variant", F.coalesce("s.tags", F.array().cast("array<string>")).alias("tags"),
        status.alias("status"), F.col("s.at").alias("started_at"), F.when(over, F.col("c.at")).alias("ended_at"),
        F.when(F.col("r.seq") > F.col("s.seq"), F.struct("r.archive", "r.stats")).alias("result"),
        loaded.alias("context_loaded"), F.when(loaded, F.col("s.preview")).alias("context_preview"),
    )


def task_statistics(events: DataFrame) -> DataFrame:
    """Totals, agents and projects in one pass: ``level`` (total, agent, project), ``name``, counts by status, ``agents``, ``projects``, ``last_task, last_project``.

    An agent counts from its first start, also if another has taken its task; a project
    as long as it has a task.
    """
    events = uncleared(events)
    tasks = task_log(events).select("agent_id", "project_id", "status", *[F.lit(None).cast(t).alias(c) for c, t in (("task_id", "string"), ("seq", "bigint"))])
    starts = events.where("action = 'start'").select("agent_id", "project_id", F.lit(None).cast("string").alias("status"), "task_id", "seq")
    own, begun = F.col("status").isNotNull(), F.col("seq").isNotNull()
    counts = [F.count_if(own).alias("total_tasks"), *[F.count_if(F.col("status") == s).alias(s) for s in ("running", "completed", "cancelled")]]
    # One row of nothing, so that an empty log has totals too.
    nothing = starts.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in starts.schema.fields])
    rows = tasks.unionByName(starts).unionByName(nothing).withColumns({
        "_agent": F.when(begun, F.col("agent_id")), "_project": F.when(own, F.col("project_id")), "_worker": F.when(own, F.col("agent_id")), "_of": F.col("project_id"),
    })
    sets = rows.groupingSets([[], ["agent_id"], ["project_id"]], "agent_id", "project_id").agg(
        F.grouping_id().alias("_set"), F.count_if(own | begun).alias("_rows"), *counts, F.count_distinct("_agent").alias("_agents"), F.count_distinct("_worker").alias("_workers"),
        F.count_distinct("_project").alias("_projects"), F.max_by(F.struct("task_id", "_of"), "seq").alias("last"),
    )
    # Bits of the grouping id: 1 for a column that is summed over.
    level = F.when(F.col("_set") == 3, "total").when(F.col("_set") == 1, "agent").otherwise("project")
    agent = F.col("level") == "agent"
    return sets.withColumn("level", level).where(F.when(F.col("level") == "project", F.col("total_tasks") > 0).when(agent, F.col("_rows") > 0).otherwise(True)).select(
        "level", F.when(agent, F.col("agent_id")).otherwise(F.col("project_id")).alias("name"), "total_tasks", "running", "completed", "cancelled",
        F.when(F.col("level") == "total", F.col("_agents")).when(~agent, F.col("_workers")).alias("agents"), F.when(F.col("level") == "total", F.col("_projects")).alias("projects"),
        F.when(agent, F.col("last.task_id")).alias("last_task"), F.when(agent, F.col("last._of")).alias("last_project"),
    )


def filter_tasks(tasks: DataFrame, agent_id: str | None = None, project_id: str | None = None,
                 status: str | None = None) -> DataFrame:
    for column, value in (("agent_id", agent_id), ("project_id", project_id), ("status", status)):
        if value:
            tasks = tasks.where(F.col(column) == value)
    return tasks


def _counts():
    return [F.count("*").alias("total_tasks")] + [
        F.count_if(F.col("status") == s).alias(s) for s in ("running", "completed", "cancelled")
    ]


def task_stats(tasks: DataFrame) -> DataFrame:
    return tasks.agg(*_counts(), F.count_distinct("agent_id").alias("agents"), F.count_distinct("project_id").alias("projects"))


def agent_stats(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """Per agent the task counts and the task and project it started last."""
    last = events.where(F.col("action") == "start").groupBy("agent_id").agg(
        F.max_by(F.struct("task_id", "project_id"), F.col("seq")).alias("last")
    )
    counts = tasks.groupBy("agent_id").agg(*_counts())
    names = ("total_tasks", "running", "completed", "cancelled")
    return last.join(counts, "agent_id", "left").select(
        "agent_id",
        *[F.coalesce(n, F.lit(0)).alias(n) for n in names],
        F.col("last")["task_id"].alias("last_task"),
        F.col("last")["project_id"].alias("last_project"),
    )


def project_stats(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("project_id").agg(F.count("*").alias("total_tasks"), F.count_distinct("agent_id").alias("agents"))


def project_agents(tasks: DataFrame) -> DataFrame:
    """Which agents worked on which project, one row per pair."""
    return tasks.select("project_id", "agent_id").distinct()


def store_status(chunks: DataFrame, sessions: DataFrame) -> DataFrame:
    """Store overview: chunks per project, chunks per author, archives per agent."""
    null = F.lit(None)
    def counted(kind: str, column: str, default: str) -> DataFrame:
        name = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(default))
        return chunks.groupBy(name.alias("name")).agg(F.count("*").alias("n")).select(
            F.lit(kind).alias("kind"), "name", "n", null.cast("bigint").alias("summarized"), null.cast("string").alias("last_ts"))

    archives = sessions.groupBy("agent_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "summarized").alias("summarized"),
        F.max_by("session_ts", "session_no").alias("last_ts"),
    ).select(F.lit("sessions").alias("kind"), F.col("agent_id").alias("name"), "n", "summarized", "last_ts")
    return counted("project", "project_id", "general").unionAll(counted("author", "agent_id", "-")).unionAll(archives)
