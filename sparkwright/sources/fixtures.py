"""The student database of the examples, generated by rule and seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.session import Engine

#: Students and enrolments of each profile.
PROFILES = {
    "smoke": (5_000, 5_000),
    "bench-small": (50_000, 100_000),
    "bench-medium": (200_000, 500_000),
    "bench-large": (500_000, 2_000_000),
}
#: Grades.
GRADES = ("A", "A-", "B+", "B", "B-", "C+", "C", "C-", "D", "F")

DEPARTMENTS, COURSES, SECTIONS, PROFESSORS = 12, 36, 108, 24

SCHEMA = """
create table dept (did int, dname varchar(8));
create table student (sid int, sname varchar(10), majorid int, gradyear int);
create table course (cid int, title varchar(20), deptid int);
create table sect (sectid int, courseid int, prof varchar(8), yearoffered int);
create table enroll (eid int, studentid int, sectionid int, grade varchar(2));
"""
#: Indexed columns of each table.
INDEXED = {"dept": ("did",), "student": ("sid", "majorid", "gradyear"), "course": ("cid", "deptid"), "sect": ("sectid", "courseid", "yearoffered"), "enroll": ("eid", "studentid", "sectionid")}


def _pick(n: int, salt: str, seed: int) -> Column:
    """A number from 0 to n - 1 that a row's id, the salt and the seed determine."""
    return F.pmod(F.xxhash64("id", F.lit(salt), F.lit(seed)), F.lit(n)).cast("int")


def tables(spark: SparkSession, profile: str = "smoke", seed: int = 42) -> dict[str, DataFrame]:
    """The five tables, generated by the executors."""
    students, enrolments = PROFILES[profile]
    number = F.col("id").cast("int")
    return {
        "dept": spark.range(DEPARTMENTS).select(((number + 1) * 10).alias("did"), F.concat(F.lit("dept"), number + 1).alias("dname")),
        "student": spark.range(1, students + 1).select(number.alias("sid"), F.concat(F.lit("s"), _pick(97, "name", seed)).alias("sname"), ((_pick(DEPARTMENTS, "major", seed) + 1) * 10).alias("majorid"), (2018 + _pick(8, "year", seed)).alias("gradyear")),
        "course": spark.range(COURSES).select((1000 + number).alias("cid"), F.concat(F.lit("course "), number).alias("title"), ((F.pmod(number, F.lit(DEPARTMENTS)) + 1) * 10).alias("deptid")),
        "sect": spark.range(SECTIONS).select((2000 + number).alias("sectid"), (1000 + F.pmod(number, F.lit(COURSES))).alias("courseid"), F.concat(F.lit("prof"), _pick(PROFESSORS, "prof", 0)).alias("prof"), (2017 + _pick(8, "offered", 0)).alias("yearoffered")),
        "enroll": spark.range(1, enrolments + 1).select(number.alias("eid"), (1 + _pick(students, "student", seed)).alias("studentid"), (2000 + _pick(SECTIONS, "section", seed)).alias("sectionid"), F.element_at(F.array(*map(F.lit, GRADES)), _pick(len(GRADES), "grade", seed) + 1).alias("grade")),
    }


def create(engine: Engine, profile: str = "smoke", seed: int = 42, kind: str = "hash") -> None:
    """Creates, indexes and fills the five tables, and commits."""
    for sql in SCHEMA.split(";"):
        if sql.strip():
            engine.update(sql)
    for table, columns in INDEXED.items():
        for column in columns:
            engine.update(f"create index {table}_{column} on {table}({column}) using {kind}")
    for name, df in tables(engine.spark, profile, seed).items():
        engine.append(name, df)
    engine.commit()
