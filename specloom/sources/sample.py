"""The built-in sample document, for when no file was given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.operators import extract

# The sample document's name and the text of its pages.
SAMPLE_NAME = "1403 AB - 33 Rev03(1).pdf"
SAMPLE_PAGES = (
    """
1403 AB - 33 Rev03
Sprinkleranlegg A10
Tørropplegg for brannvesen / fire department connection
Våtanlegg sprinkleranlegg
Delugeanlegg fasade
NFPA 13
NFPA 14
Systemtrykk 12 bar
""",
    """
1403.33.332.1.1 Rillede rør for sprinkleranl. Pulverlakkert DN100 m 29,16
1403.33.332.1.2 Rillede rør for sprinkleranl. Pulverlakkert DN80 m 72,78
1403.33.332.1.3 Rillede rør for sprinkleranl. Pulverlakkert DN65 m 57,32
1403.33.332.1.4 Rillede rør for sprinkleranl. Pulverlakkert DN50 m 496,46
1403.33.332.1.5 Rillede rør for sprinkleranl. Pulverlakkert DN40 m 223,83
1403.33.332.1.6 Rillede rør for sprinkleranl. Pulverlakkert DN32 m 910,05
1403.33.332.1.7 Rillede rør for sprinkleranl. Pulverlakkert DN25 m 54,75
1403.33.332.2.1 Rillerør Bend DN32 stk 188
1403.33.332.2.2 Rillerør Bend DN25 stk 127
1403.33.332.3.1 Fleksibelslange Sprinkleranlegg DN25 stk 386
""",
    """
1403.33.333.1.1 Standard Spray, Nedadrettet, QR K=80, 68°C stk 306
1403.33.333.1.2 Standard Spray, Oppadrettet, QR K=80, 68°C stk 220
1403.33.333.1.3 Standard Spray, Nedadrettet, QR K=80, 68°C stk 118
1403.33.334.1.1 Kuleventil, Drenering våt DN32 stk 9
1403.33.334.1.2 Stengeventil med gir, overvåket DN65 stk 5
1403.33.334.1.3 Tilbakeslagsventil DN65 stk 5
1403.33.335.1.1 Strømningsvakt stk 6
1403.33.335.1.2 I/O Enhet Strømningsvakt stk 6
""",
)
_MESSAGE = "Loaded the local sample extraction fixture because no PDF file was submitted."


def sample_pages(spark: SparkSession, doc_id: str = "sample") -> DataFrame:
    rows = [(doc_id, SAMPLE_NAME, k, k + 1, text) for k, text in enumerate(SAMPLE_PAGES)]
    return extract.normalize_pages(spark.createDataFrame(rows, "doc_id string, file_name string, page_ord int, page_number int, text string"))


def sample_warnings(pages: DataFrame) -> DataFrame:
    """The sample's warnings, the first of which says that it is the sample; ord is their order."""
    own = pages.select("doc_id").distinct().select("doc_id", F.lit("warning-sample-fallback").alias("id"), F.lit("SAMPLE_TEXT_FALLBACK").alias("code"), F.lit(_MESSAGE).alias("message"), F.lit("info").alias("severity"))
    return own.withColumn("ord", F.lit(0)).unionByName(extract.warnings(pages).withColumn("ord", F.lit(1)))
