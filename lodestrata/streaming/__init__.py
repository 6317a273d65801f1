"""lodestrata streaming"""
