"""lodestrata sources"""
