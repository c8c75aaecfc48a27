"""Recorded answers of a model server, checked where they are: as variant data, with what is wrong with each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions.text import strip

#: What may be wrong, in the order in which it is looked for.
FAULTS = ("missing", "json", "form", "length", "choice", "number", "range")


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def checked_answers(answers: DataFrame, body: str = "body", options: str = "options") -> DataFrame:
    """Adds choice and fault to answers with a server's body and the number of options; one of the two is null.

    missing: there is no body; json: it isn't JSON (a key twice in an object included); form: it has no first choice with a message;
    length: the model used its tokens up and said nothing; choice: what it says is no JSON object with a choice; number: that is no
    whole number; range: it is none of the options. Nothing is rounded or cut to fit.
    """
    whole = F.try_parse_json(body)
    first = F.try_variant_get(whole, "$.choices[0]", "variant")
    message = F.try_variant_get(first, "$.message", "variant")
    content = F.try_variant_get(message, "$.content", "variant")
    said = strip(F.when(_is(content, "STRING"), F.try_variant_get(content, "$", "string")))
    inner = F.try_parse_json(said)
    choice = F.try_variant_get(inner, "$.choice", "variant")
    rows = answers.withColumns({"_whole": whole, "_first": first, "_message": message, "_content": content, "_said": said, "_choice": choice, "_reason": F.try_variant_get(first, "$.finish_reason", "string")})
    empty = F.col("_content").isNull() | _is(F.col("_content"), "VOID") | (F.col("_said") == "")
    number = F.try_variant_get("_choice", "$", "long")
    # Variants don't tell 2.0 from 2; the text does, and the variant tells 2 from "2".
    integral = F.coalesce(F.schema_of_variant("_choice").rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$") & F.get_json_object("_said", "$.choice").rlike(r"^-?\d+$"), F.lit(False))
    fault = (
        F.when(F.col(body).isNull(), "missing")
        .when(F.col("_whole").isNull(), "json")
        .when(~_is(F.col("_first"), "OBJECT") | ~_is(F.col("_message"), "OBJECT"), "form")
        .when(empty & F.coalesce(F.col("_reason") == "length", F.lit(False)), "length")
        .when(F.col("_choice").isNull(), "choice")
        .when(~integral, "number")
        .when(~F.coalesce(number.between(1, F.col(options)), F.lit(False)), "range")
    )
    rows = rows.withColumn("fault", fault).withColumn("choice", F.when(F.col("fault").isNull(), number).cast("int"))
    return rows.select(*answers.columns, "choice", "fault")
