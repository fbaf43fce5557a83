"""The seven domains of codes that captures use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Public graphics constants by domain.
DOMAINS = {
    "internal_format": """
        1902 84F9 1903 8227 1907 1908
        8229 8F94 822A 8F98 822B 8F95 822C 8F99 2A10 804F 8050 8051 8F96 8052 8053 8054 8F9A 8055
        8056 8057 8058 8F97 8059 906F 805A 805B 8F9B 8C41 8C43 822D 822F 881B 881A 822E
        8230 8815 8814 8C3A 8C3D 8231 8232 8233 8234 8235 8236 8237 8238 8239 823A 823B 823C 8D8F
        8D7D 8D89 8D77 8D83 8D71 8D8E 8D7C 8D88 8D76 8D82 8D70 1909 190A 803C
        8225 8226 84ED 84EE 8C48 8C49 8DBB 8DBC 8DBD 8DBE 8E8C 8E8D 8E8E 8E8F""",
    "format": "1903 8227 1907 80E0 1908 80E1 8D94 8228 8D98 1909 190A 8D9A 8D99 8D9B 1901 1902 84F9 1906",
    "pixel_type": "1401 1400 1403 1402 1405 1404 1406 8032 8362 8363 8364 8033 8365 8034 8366 8035 8367 8036 8368",
    "texture_parameter": "2800 2801 2802 2803 8072 8191 8192 813C 813D 813A 813B 1004 8501 884C 884D 8E42 8E43 1005 8E44 8E45 8E46 90EA 84FE",
    "texture_env_mode": "2200 2201 8501 8571 8572 8580 8581 8582 8588 8589 858A 8590 8591 8592 8598 8599 859A 8573 0D1C 8862",
    "texture_env_op": "0104 8574 8575 2100 2101 0BE2 1E01 84E7 8570 1702 8576 8577 8578 0300 0301 0302 0303",
    "buffer_usage": "88E0 88E1 88E2 88E4 88E5 88E6 88E8 88E9 88EA",
}


def codes_of(domain: str) -> list[int]:
    return [int(x, 16) for x in DOMAINS[domain].split()]


def domain_table(spark: SparkSession) -> DataFrame:
    """All domains as rows (domain, code)."""
    return spark.createDataFrame([(d, c) for d in DOMAINS for c in codes_of(d)], "domain string, code bigint")
