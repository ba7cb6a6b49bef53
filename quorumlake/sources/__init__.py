"""quorumlake.sources"""
