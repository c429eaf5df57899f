"""Header clean-up and the text of a forecast explanation."""

from pyspark.sql import Column, functions as F

# Fixed value: the wording of the explanation request, as a format string.
EXPLANATION = """
You are an assistant that explains demand-forecast outputs to a supply planner.
Given:
- City: %s
- Product: %s
- Predicted units (next 7 days): %s
- Model contributions:
%s

Recent sales (last rows):
%s

Please:
1. Give a short plain-language summary (2-3 lines).
2. Explain why the model might predict that amount (point out contribution magnitudes).
3. Suggest 3 practical actions (e.g., allocate from warehouse X, reorder suggestions, safety stock).
Use bullet points and keep it concise.
"""


def normal_header(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def contribution_lines(contributions: dict[str, str]) -> Column:
    """One `- name: 1.23` line per model, in the given order."""
    return F.concat_ws(
        "\n",
        *[
            F.format_string(f"- {name}: %.2f", F.col(column))
            for name, column in contributions.items()
        ],
    )


def explanation(city, product, predicted, contributions, recent) -> Column:
    text = F.col(predicted).cast("double").cast("string")
    return F.format_string(
        EXPLANATION, F.col(city), F.col(product), text, contributions, recent
    )
