"""DataFrame operators: lexicon, layout, tables, placement, voting, partitioning."""
