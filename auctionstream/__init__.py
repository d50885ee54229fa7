"""Online-auction analytics (people, auctions, bids) as plain PySpark DataFrame functions."""
