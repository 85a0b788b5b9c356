"""Control logic around the tables: kill switch, routing, response codes, layered registries, sequences."""

from __future__ import annotations

import time
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that make a question hard, and messages by error code (fixed values).
HARD_WORDS = ("분석", "비교", "왜", "어떻게", "차이", "요약", "정리", "계산", "추론")
MESSAGES = {
    "E001": "사용자 인증 실패: 레거시 시스템 접근 권한을 확인하세요.",
    "E002": "필수 파라미터 누락: 요청 데이터를 확인하세요.",
    "E003": "레거시 시스템 내부 오류: 관리자에게 문의하세요.",
    "E999": "알 수 없는 오류가 발생했습니다.",
}


class KillSwitch:
    """Stops jobs before they are submitted; remembers its last 1000 events; may switch itself off."""

    def __init__(self, clock=time.time):
        self.clock, self.reason, self.until = clock, None, None
        self.history: deque = deque(maxlen=1000)
        self._on = False

    @property
    def active(self) -> bool:
        if self._on and self.until is not None and self.clock() >= self.until:
            self.deactivate("timed out")
        return self._on

    def activate(self, reason: str, seconds: float | None = None) -> None:
        self._on, self.reason = True, reason
        self.until = None if seconds is None else self.clock() + seconds
        self.history.append(("activated", self.clock(), reason))

    def deactivate(self, reason: str | None = None) -> None:
        if self._on:
            self._on, self.reason, self.until = False, None, None
            self.history.append(("deactivated", self.clock(), reason))

    def guard(self) -> None:
        if self.active:
            raise RuntimeError(f"stopped: {self.reason}")


def hard_question(text: Column) -> Column:
    """Long, asking twice, asking to think, or with a word that makes it hard."""
    low = F.lower(text)
    return (F.length(text) > 100) | (F.length(text) - F.length(F.replace(text, F.lit("?"))) > 1) | F.contains(low, F.lit("think")) | text.rlike("|".join(HARD_WORDS))


def response_result(status: Column, body: Column) -> dict[str, Column]:
    """success, error_code and message of an answer with a header in JSON."""
    code = F.get_json_object(body, "$.header.resultCode")
    good = (status < 400) & (code == "0000")
    named = F.when(F.try_parse_json(body).isNull(), F.lit("응답 파싱 실패")).otherwise(F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv]), F.coalesce(code, F.lit("E999"))), F.lit(MESSAGES["E999"])))
    fine = F.coalesce(good, F.lit(False))
    return {"success": fine, "error_code": F.when(~fine & F.try_parse_json(body).isNotNull(), F.coalesce(code, F.lit("E999"))), "message": F.when(~fine, named)}


def layered(layers: list[DataFrame], key: str) -> DataFrame:
    """Rows by key, those of a later layer in place of an earlier one's."""
    tagged = [df.withColumn("_l", F.lit(i)) for i, df in enumerate(layers)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    rest = [c for c in layers[0].columns if c != key]
    return every.groupBy(key).agg(F.max_by(F.struct(*rest), "_l").alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def many_versions(docs: DataFrame) -> DataFrame:
    """path, many: whether a document has more than one version label."""
    return docs.groupBy("path").agg((F.count_distinct("label") > 1).alias("many"))


def by_category(permissions: DataFrame) -> DataFrame:
    return permissions.groupBy("category").agg(F.array_join(F.sort_array(F.collect_list("permission")), ",").alias("permissions"))


def continued_text(parts: DataFrame) -> DataFrame:
    """call, text: the pieces of a streamed call in order, in one."""
    return parts.groupBy("call").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "piece"))), lambda x: x["piece"]), "").alias("text"))


def device_lines(text: DataFrame) -> DataFrame:
    """Columns of comma-separated device lines.  text: line."""
    return text.select(F.from_csv("line", "idx int, name string, memory_total int, memory_used int, memory_free int, utilization int, temperature int", {"ignoreLeadingWhiteSpace": "true"}).alias("d")).select("d.*")


def masked_keys(keys: DataFrame, user: str, admin: bool) -> DataFrame:
    """The keys that a user may list, middles hidden."""
    seen = keys if admin else keys.where(F.col("user_id") == user)
    return seen.select("user_id", "label", F.concat(F.left("key", F.lit(8)), F.lit("..."), F.right("key", F.lit(4))).alias("key"))
