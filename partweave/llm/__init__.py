"""Training-data operators: text quality, near duplicates, secrets, tokens, packing, web text.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame and column names,
reads only those columns (so extra or clashing columns do no harm) and returns a DataFrame.
"""
