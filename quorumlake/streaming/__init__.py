"""quorumlake.streaming"""
