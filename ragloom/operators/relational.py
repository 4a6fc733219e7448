"""Courses, members and their analytics as joins over plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def course_list(courses: DataFrame, enrolments: DataFrame, users: DataFrame) -> DataFrame:
    """user_id and course columns: a teacher's own courses, a student's enrolled ones.  users: user_id, role."""
    own = users.where("role = 'teacher'").join(courses, F.col("user_id") == F.col("teacher_id")).select("user_id", *courses.columns)
    joined = users.where("role = 'student'").join(enrolments.select("user_id", "course_id"), "user_id").join(courses, "course_id").select("user_id", *courses.columns)
    return own.unionByName(joined)


def enrolled_students(users: DataFrame, enrolments: DataFrame, course: object | None = None) -> DataFrame:
    chosen = enrolments if course is None else enrolments.where(F.col("course_id") == course)
    return users.join(chosen.select("user_id", "course_id"), "user_id")


def course_analytics(courses: DataFrame, enrolments: DataFrame, materials: DataFrame, quizzes: DataFrame, results: DataFrame) -> DataFrame:
    """Students, materials, quizzes, results and the mean score of each course; 0 where there is none.

    Each table is aggregated by course before it is joined, so no join multiplies another's rows.
    """
    count = lambda df, name: df.groupBy("course_id").agg(F.count("*").alias(name))
    scored = results.join(quizzes.select("quiz_id", "course_id"), "quiz_id").groupBy("course_id").agg(F.count("*").alias("n_results"), F.round(F.avg("score"), 1).alias("avg_score"))
    out = courses.select("course_id")
    for part in (count(enrolments, "n_students"), count(materials, "n_materials"), count(quizzes, "n_quizzes"), scored):
        out = out.join(part, "course_id", "left")
    return out.na.fill(0)


def members(pairs: DataFrame, courses: DataFrame, enrolments: DataFrame) -> DataFrame:
    """Of (user_id, course_id) pairs those whose user owns the course or is enrolled."""
    owners = courses.select(F.col("teacher_id").alias("user_id"), "course_id")
    return pairs.join(owners.union(enrolments.select("user_id", "course_id")).distinct(), ["user_id", "course_id"], "left_semi")


def enrol(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The pairs that are not there yet, once each."""
    return new.dropDuplicates(["user_id", "course_id"]).join(existing.select("user_id", "course_id"), ["user_id", "course_id"], "left_anti")


def without_courses(gone: DataFrame, *tables: DataFrame) -> tuple[DataFrame, ...]:
    """Each table without the rows of courses that go."""
    ids = gone.select("course_id").distinct()
    return tuple(t.join(ids, "course_id", "left_anti") for t in tables)


def marked_catalog(courses: DataFrame, enrolments: DataFrame, user: object) -> DataFrame:
    """Every course, with whether the user is enrolled."""
    own = enrolments.where(F.col("user_id") == user).select("course_id").distinct().withColumn("enrolled", F.lit(True))
    return courses.join(own, "course_id", "left").withColumn("enrolled", F.coalesce("enrolled", F.lit(False)))


def history_search(history: DataFrame, text: str, columns: tuple[str, ...] = ("message", "response")) -> DataFrame:
    return history.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.lower())))


def material_kind(file_type: Column, name: Column) -> Column:
    video = F.lower(F.coalesce(file_type, F.lit(""))).contains("video") | F.lower(F.coalesce(name, F.lit(""))).contains("youtube")
    return F.when(video, "video").otherwise("document")


def recent_turns(history: DataFrame, keys: list[str], order: str, most: int = 4, chars: int = 500) -> DataFrame:
    """The last turns of each user and course, oldest first, as one text; responses are cut.  Partial top-k before the shuffle."""
    from pyspark.sql import Window

    last = history.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("__at") <= most)
    line = F.concat(F.lit("User: "), F.coalesce("message", F.lit("")), F.lit("\nAssistant: "), F.substring(F.coalesce("response", F.lit("")), 1, chars))
    return last.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("__at")).alias("o"), line.alias("line")))), lambda s: s["line"]), "\n").alias("turns"))


def catalog(courses: DataFrame, created: str = "created_at") -> DataFrame:
    """All courses, the newest first."""
    return courses.orderBy(F.desc(created), "course_id")


def listed(rows: DataFrame, order: str, **equal: object) -> DataFrame:
    """Materials, quizzes or history: the rows whose columns have these values, the latest first."""
    for name, value in equal.items():
        rows = rows.where(F.col(name).eqNullSafe(F.lit(value)))
    return rows.orderBy(F.desc(order))


def open_codes(codes: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """Of (email, code) pairs those that stand in ``codes`` (email, code, expires, verified), unexpired and not yet used."""
    live = codes.where((F.col("expires") >= now) & ~F.coalesce("verified", F.lit(False)))
    return asked.join(live.select("email", "code").distinct(), ["email", "code"], "left_semi")
