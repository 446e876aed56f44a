"""A small dimension of interface phrases, for queries over tables that hold no such text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Phrases and translations; one keeps other placeholders, one is blank, on purpose.
PHRASES = [
    ("确认删除吗？", "Are you sure you want to delete?"),
    ("是否保存修改？", "Save changes?"),
    ("保存成功", "Saved"),
    ("提交成功", "Submitted"),
    ("已完成", "Completed"),
    ("删除失败", "Delete failed"),
    ("发生未知错误，请稍后重试", "Unknown error"),
    ("不能为空", "Required"),
    ("服务器错误", "Server error"),
    ("保存", "Save"),
    ("删除", "Delete"),
    ("提交表单", "Submit form"),
    ("查看详情", "View details"),
    ("请输入用户名", "Enter user name"),
    ("请选择 日期", "Pick a date"),
    ("系统设置", "System settings"),
    ("用户名输入框", "User name box"),
    ("用户权限管理与系统配置中心", "Permission centre"),
    ("欢迎回来，{value0}", "Welcome back, {value0}"),
    ("列：{col_title}", "Column: {col_title}"),
    ("{a} 与 {a}", "{a} and {b}"),
    ("VIP用户　专享", "VIP only"),
    ("重量(g)", "Weight (g)"),
    ("很好", ""),
]


def phrases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *p) for i, p in enumerate(PHRASES)], "pid int, phrase string, translated string")


def phrases_sql() -> str:
    """The same table as a common table expression."""
    rows = ", ".join("({}, '{}', '{}')".format(i, a.replace("'", "''"), b.replace("'", "''")) for i, (a, b) in enumerate(PHRASES))
    return f"phrases(pid, phrase, translated) AS (VALUES {rows})"
