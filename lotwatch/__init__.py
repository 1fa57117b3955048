"""lotwatch: watching marketplaces and auctions with Spark DataFrames."""
