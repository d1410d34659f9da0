import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from kinlink.errors import ConfigError
from kinlink.functions import normalize


def run(spark, values, steps):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in sorted(df.select("i", normalize.apply(F.col("v"), steps).alias("o")).collect())]


def step(op, **o):
    return [{"op": op, "options": o}]


def test_identity_keeps_everything(spark):
    assert run(spark, ["88", "N/A", "", None], []) == ["88", "N/A", "", None]


def test_chain(spark):
    s = step("trim") + step("punctuation_map", chars="-") + step("case_map", mode="lower")
    assert run(spark, ["  ABC-01  "], s) == ["abc01"]


def test_dictionary(spark):
    m = {"SUS304": "304不锈钢", "六角螺栓": "HEX_BOLT"}
    assert run(spark, ["SUS304 六角螺栓"], step("dictionary_map", mapping=m, mode="replace")) == ["304不锈钢 HEX_BOLT"]
    assert run(spark, ["sus304", "UNKNOWN"], step("dictionary_map", mapping=m, case_sensitive=False, on_missing="null")) == ["304不锈钢", None]
    assert run(spark, ["a b"], step("dictionary_map", mapping={"a": "b", "b": "a"}, mode="replace")) == ["b a"]


def test_standard_numbers(spark):
    v = ["GB/T 1303.1-1998", "GBT1303.1-1998", "GB-T 1303.1-1998", "ＧＢ／Ｔ　１３０３．１－１９９８"]
    assert run(spark, v, step("standard_number_normalize")) == ["GB/T1303.1-1998"] * 4


def test_specifications(spark):
    assert run(spark, ["φ 8 mm", "Φ8", "∅8毫米", "8 * 10 mm"], step("specification_normalize")) == ["Φ8", "Φ8", "Φ8", "8×10"]


def test_model_and_manufacturer(spark):
    assert run(spark, ["  jt 54ls14k  "], step("model_normalize")) == ["JT54LS14K"]
    assert run(spark, ["天水华天微电子有限公司", "天水 华天微电子 公司", "公司"], step("manufacturer_normalize")) == ["天水华天微电子", "天水华天微电子", "公司"]


def test_nullify_and_regex(spark):
    assert run(spark, ["88", "-", "x"], step("nullify", values=["88", "-"])) == [None, None, "x"]
    assert run(spark, ["ab12"], step("regex_replace", pattern=r"(?P<a>[a-z]+)(\d+)", replacement=r"\g<2>-\1$")) == ["12-ab$"]


@pytest.mark.parametrize("a,z", [(0, None), (1, 3), (-3, None), (-4, -1), (2, -5), (5, 2), (-99, 2)])
def test_substring_is_a_slice(spark, a, z):
    v = ["", "a", "abcdef", "😀bç", None]
    assert run(spark, v, step("substring", start=a, end=z)) == [None if x is None else x[a:z] for x in v]


def test_random_strings(spark):
    r = random.Random(4)
    alphabet = "aZ ß　 \t\n\x1fÅ①ｆé-.，。"
    v = ["".join(r.choices(alphabet, k=r.randint(0, 9))) for _ in range(300)]
    assert run(spark, v, step("trim")) == [x.strip() for x in v]
    assert run(spark, v, step("whitespace_map", replacement="$1")) == [re.sub(r"\s+", "$1", x) for x in v]
    assert run(spark, v, step("unicode_normalize")) == [unicodedata.normalize("NFKC", x) for x in v]
    assert run(spark, v, step("case_map", mode="upper")) == [x.upper() for x in v]


def test_errors():
    with pytest.raises(ConfigError, match="PROCESSING_OPERATOR_NOT_FOUND"):
        normalize.apply(_Any(), step("nonsense"))


class _Any:
    def cast(self, _):
        return self
