"""Sources: feeds, pages, configurations and listings as DataFrames."""
