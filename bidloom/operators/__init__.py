"""Set-oriented operators over all tenders at once."""
