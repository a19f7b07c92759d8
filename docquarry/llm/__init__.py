"""Training-data operators: tokenising, filtering, deduplication and mixing.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame
with an id column (``doc_id``) and a text column (``text``) and returns only the
id and its own columns, so extra input columns, whatever their names, are
neither read nor able to clash.  A null text counts as the empty text unless an
operator's docstring says otherwise; repeated rows are treated one by one.
"""
